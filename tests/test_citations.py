"""Citation markers against a plain version in Python."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import citations

GROUP = re.compile(r"\[\s*(S\d+(?:\s*[,，、;；]\s*S\d+)*)\s*\]", re.I | re.A)
PIECES = ["word", "text.", " ", "  ", "\n", "\n\n", "[S1]", "[S1, S2]", "[ s3；S1 ]", "[S9]", "\t", "　", " .", "，", "[S]", "[x]", "end"]


def ids_of(text, allowed):
    out = []
    for g in GROUP.finditer(text):
        for n in re.findall(r"\d+", g[1]):
            if f"S{n}" in allowed and f"S{n}" not in out:
                out.append(f"S{n}")
    return out


def canonical(text, allowed):
    merged = []
    for line in text.split("\n"):
        leading = re.match(r"[ \t]*", line)[0]
        body = GROUP.sub("", line[len(leading) :])
        body = re.sub(r"[ \t 　]+([。．.！!？?；;，,])", r"\1", body)
        body = re.sub(r"[ \t 　]+$", "", re.sub(r"[ \t 　]{2,}", " ", body))
        line = leading + body + "".join(f"[{i}]" for i in ids_of(line, allowed))
        above = [i for i, x in enumerate(merged) if x.strip()]
        if re.fullmatch(r"(?:\[S\d+\])+", line.strip()) and above:
            merged[above[-1]] = merged[above[-1]].rstrip(" \t") + line.strip()
        else:
            merged.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(merged)).rstrip()


def linked(text, allowed):
    def one(run):
        ids = ids_of(run[0], allowed)
        return f"[来源](citation:{','.join(ids)})" if ids else run[0]

    return re.sub(r"(?:\[S\d+\])+", one, text)


def test_canonical_and_linked(spark):
    rng, allowed = random.Random(6), ["S1", "S2", "S3"]
    texts = ["", "[S1]", "\n[S1]\n[S2]", "a [S1] b\n\n [S2] \n[S3][S9]\nend  ", *["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    of = F.array(*[F.lit(a) for a in allowed])
    made = df.select("id", citations.markers_of(F.col("text"), of).alias("ids"), citations.canonical(F.col("text"), of).alias("content")).withColumn("links", citations.linked(F.col("content"), of))
    for r in made.collect():
        assert r.ids == ids_of(texts[r.id], allowed)
        assert r.content == canonical(texts[r.id], allowed), texts[r.id]
        assert r.links == linked(r.content, allowed)
    again = made.select("content", citations.canonical(F.col("content"), of).alias("again")).collect()
    assert all(r.again == canonical(r.content, allowed) for r in again)
