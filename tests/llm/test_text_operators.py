import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import language_id, licences, packing, quality_classifier, quality_rules, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, rows, schema="doc_id long, text string, score string, lang string"):
    return spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], schema)


EDGE = [(900, None), (901, ""), (902, " \n\t "), (903, "a"), (904, "word " * 5000), (905, "dup"), (905, "dup"), (None, "no id")]


# ---- quality rules ---------------------------------------------------------------------------


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    repeated = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)} if len(windows) < 3000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(w) if repeated is None else len(repeated)


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        w = [rng.choice("ab") if i % 3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t ", " % ", "\n\n", "\x0b"]) for x in w)))
    rows += EDGE
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *measured(t)) for i, t in rows), key=str)


def test_the_order_of_rules_never_changes_a_verdict(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose), (2, prose.upper()), (3, prose.replace(" ", " %% ")), (4, "x " * 30), (5, "\n".join([prose, "same line"] + ["same line"] * 9)), (6, "short")] + EDGE
    df = docs_of(spark, rows)
    verdicts = [{(r.doc_id, r.kept) for r in quality_rules.quality_rules(df, rules).collect()} for rules in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    assert {i for i, k in verdicts[0] if k} == {1}
    by_id = {r.doc_id: r.rejected_by for r in quality_rules.quality_rules(df).collect()}
    assert by_id[1] is None and by_id[2] == "shouting" and by_id[3] == "symbols" and by_id[5] == "repeated_lines" and by_id[6] == "base"


def test_cheap_selective_rules_come_first(spark):
    rows = [(i, (" %% " if i % 2 else " ").join(f"word{j}" for j in range(50))) for i in range(40)]
    names = [r.name for r in quality_rules.ordered_rules(docs_of(spark, rows))]
    assert names[0] == "symbols" and sorted(names) == sorted(r.name for r in quality_rules.RULES)
    empty = docs_of(spark, rows).limit(0)
    assert [r.name for r in quality_rules.ordered_rules(empty)] == [r.name for r in quality_rules.RULES]
    assert quality_rules.quality_rules(docs_of(spark, rows).limit(0)).count() == 0


def test_rejection_counts_what_earlier_rules_let_pass():
    # The second rule rejects most, but after the first only rows that the third rejects as well.
    patterns = {(True, True, False): 50, (False, True, True): 10, (False, False, True): 20, (False, False, False): 20}
    assert quality_rules.by_rejection_per_cost([1.0, 2.0, 1.0], patterns) == [0, 2, 1]
    assert quality_rules.by_rejection_per_cost([1.0, 1.0, 1.0], patterns) == [1, 2, 0]
    assert quality_rules.by_rejection_per_cost([3.0, 2.0, 1.0], {(False, False, False): 5}) == [2, 1, 0]
    assert quality_rules.by_rejection_per_cost([], {}) == []


# ---- licences ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,labels,permissive,canonical",
    [
        ("mit", {"mit"}, True, "mit"),
        ("mit or gpl-3.0-only and apache-2.0", {"mit", "gpl-3", "apache-2"}, True, "(mit OR (gpl-3.0-only AND apache-2.0))"),
        ("(mit or gpl-3.0-only) and apache-2.0", {"mit", "gpl-3", "apache-2"}, True, "((mit OR gpl-3.0-only) AND apache-2.0)"),
        ("gpl-2.0+ with classpath-exception-2.0", {"gpl-2"}, False, "(gpl-2.0+ WITH classpath-exception-2.0)"),
        ("mit and gpl-2.0 */ more words", {"mit", "gpl-2"}, False, "(mit AND gpl-2.0)"),
    ],
)
def test_expressions(text, labels, permissive, canonical):
    found = licences.evaluate(licences.to_postfix(text))
    assert (found.labels, found.permissive, found.text) == (labels, permissive, canonical)


@pytest.mark.parametrize("text", ["", "or mit", "(mit", "mit or", "and", "(", "mit or or isc"])
def test_broken_expressions(text):
    assert licences.to_postfix(text) is None


def test_licence_scan_matches_brute_force(spark):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    notices = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rng = random.Random(2)
    bits = ["under", "the", "MIT", "License", "apache", "license,", "version", "2.0", "cc", "by-nc", "BY", "NC", "é", "x y", "-", "\n", "SPDX-License-Identifier: MIT OR GPL-2.0-only\n"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(500, "Cc by NC cc-by-nc/CC BY NC"), (501, "cc by ncx"), *EDGE]
    for r in licences.licence_scan(docs_of(spark, rows)).collect():
        text = next(t for i, t in rows if i == r.doc_id) or ""
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        at = [(i, label) for p, label in notices.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert ("SPDX-License-Identifier: MIT OR GPL-2.0-only" in text) == ("(mit OR gpl-2.0-only)" in r.expressions)
    assert licences.licence_scan(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,labels,permissive,expressions",
    [
        ("SPDX-License-Identifier: Apache-2.0 OR BSL-1.0", "apache-2", True, "(apache-2.0 OR bsl-1.0)"),
        ("SPDX-License-Identifier: MIT AND Zlib", "mit", False, "(mit AND zlib)"),
        ("License: MIT and others", "mit", False, "(mit AND others)"),
        ("License-Expression: (BSL-1.0 OR GPL-2.0-only) AND Zlib", "gpl-2", False, "((bsl-1.0 OR gpl-2.0-only) AND zlib)"),
        ("License: BSL-1.0 AND Zlib", "", None, ""),
    ],
)
def test_unknown_parts_beside_known_ones(text, labels, permissive, expressions):
    found = licences.LicenceScanner().scan(text.encode())
    assert (found[5], found[8], found[7]) == (labels, permissive, expressions)
    assert found[6] == pytest.approx(0.9 if labels else 0)


@pytest.mark.parametrize("before", ["•", "“", "\u00a0", "\u3000", "许可", "é", "(", ""])
@pytest.mark.parametrize("tag", ["License:", "SPDX-License-Identifier:", "LICENSE-EXPRESSION:"])
def test_tags_that_touch_other_characters(before, tag):
    found = licences.LicenceScanner().scan(f"{before}{tag} MIT”".encode())
    assert (found[5], found[7], found[8]) == ("mit", "mit", True)


# ---- language ------------------------------------------------------------------------------------


def brute_bits(training, text, order=3):
    """Code length of a text by the definition, with the counts of one language and no pruning."""
    alphabet = sorted({b for t in training for b in t} | {32})
    size = len(alphabet) + 1
    counts = {}
    for t in training:
        padded = b"   " + t
        for i in range(3, len(padded)):
            for k in range(order + 1):
                c = counts.setdefault(padded[i - k : i], {})
                c[padded[i]] = c.get(padded[i], 0) + 1

    def p(context, symbol):
        if context is None:
            return 1 / size
        shorter = context[1:] if context else None
        c = counts.get(context)
        if not c:
            return p(shorter, symbol)
        t, d = sum(c.values()), len(c)
        if symbol in c:
            return c[symbol] / (t + d)
        left = 1 - sum(p(shorter, s) for s in c)
        return d / (t + d) * p(shorter, symbol) / left

    padded = b"   " + text
    return -sum(math.log2(p(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))


@pytest.mark.parametrize("text,labels", [
    ("sublicense: mit", ""), ("sublicense: mit; any license", ""), ("sub-license: mit", "mit"), ("license: mit", "mit"), ("7license: mit", ""), (" license: isc\nrelicense: mit", "isc"), ("xspdx-license-identifier: mit", ""),
])
def test_tags_begin_words(text, labels):
    assert licences.LicenceScanner().scan(text.encode())[5] == labels


def test_code_lengths_match_the_definition():
    training = [b"abracadabra", b"banana bandana"]
    grams = {}
    for t in training:
        padded = b"   " + t
        for i in range(3, len(padded)):
            g = int.from_bytes(padded[i - 3 : i + 1], "big")
            grams[g] = grams.get(g, 0) + 1
    trees = language_id.grow(["xx"], np.zeros(len(grams), int), np.array(list(grams)), np.array(list(grams.values()), float), least_seen=1)
    texts = [b"banana", b"abra cadabra", b"", b"zzz", b"brand"]
    found = trees.code_lengths(texts)
    for text, bits in zip(texts, found[:, 0]):
        assert bits == pytest.approx(brute_bits(training, text), rel=1e-4, abs=1e-3)


def test_code_lengths_dont_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(97, 102, (500, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))
    trees = language_id.grow(["a", "b"], rng.integers(0, 2, len(grams)), grams, np.ones(len(grams)), least_seen=1)
    texts = [bytes(rng.integers(97, 102, n).tolist()) for n in (0, 1, 5, 300, 0, 77, 2, 1000, 0)]
    whole = trees.code_lengths(texts)
    alone = np.array([trees.code_lengths([t])[0] for t in texts])
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert np.allclose(whole, alone) and np.allclose(whole, trees.code_lengths(texts))


def test_language_held_out_accuracy(spark):
    rng = random.Random(3)
    syllables = {"aa": "ka lo mi ru te so".split(), "bb": "sch ung ein ber ver keit".split(), "cc": "tion eau oux que les ment".split()}
    rows = []
    for i in range(400):
        language = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[language]) for _ in range(3)) for _ in range(12))
        rows.append((i, text.title() if i % 2 else text, language, "s"))
    edge = [(i, t, None, None) for i, t in EDGE] + [(950, "12 34 !!", "aa", None), (951, "éé", "aa", None)]
    df = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string, score string")
    got = language_id.identify(df).collect()
    lang = {r[0]: r[2] for r in rows}
    out = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(out) > 80 and all(r.lang_pred == lang[r.doc_id] for r in out)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {900, 901, 902, 950}
    assert {r.lang_pred for r in language_id.identify(df.filter("lang is null")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


# ---- packing ---------------------------------------------------------------------------------------


def test_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    texts = ["a\x0bb", "a\x1cb\u0085c d", "don't it's x.'s 'S. 're.", "<|endoftext|> a<|ENDOFTEXT|>.b <|startoftext|>x", "İstanbul ΑΣ. ΑΣ", "ét. é,, 12,3 a1.b", "中文字.好", "a…. x...!y!", "ﬁ ﬁ. Ⅷ ª", "tab\tx\ny\r\nz  ", "", "é ñ.", "🙂🙂. ok🙂!"]
    words = packing.WordTokens(path, limit=8)
    for _ in range(2):
        ids, counts = words.encode([t.encode() for t in texts])
        at = 0
        for text, n in zip(texts, counts.tolist()):
            assert ids[at : at + n].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
            at += n


def test_places_of_hashes():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(8))  # the low bits collide
    held = packing.HashPlaces(slots=4)
    for k in range(0, len(hashes), 700):
        held.add(hashes[k : k + 700], np.arange(k, min(k + 700, len(hashes)), dtype=np.int32))
    assert held.find(hashes).tolist() == list(range(len(hashes)))
    assert (held.find(hashes + np.uint64(1)) == -1).all()
    held.add(np.zeros(1, np.uint64), np.array([77], np.int32))
    assert held.find(np.zeros(2, np.uint64)).tolist() == [77, 77]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_constraint(rule):
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    capacities = packing.Capacities(100, 4, 6000 + 100 * 100)
    bins, offsets = packing.vector_best_fit(lengths, capacities, (1.0, 0.3, 0.2), rule)
    for b in range(bins.max() + 1):
        own = bins == b
        order = np.argsort(offsets[own])
        assert lengths[own].sum() <= 100 and own.sum() <= 4 and (lengths[own] ** 2).sum() <= 16000
        assert offsets[own][order].tolist() == [0, *np.cumsum(lengths[own][order])[:-1].tolist()]
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([101]), capacities)


def test_packing_is_whole_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta.", "Gamma", "12"]) for _ in range(int(rng.paretovariate(0.8) * 8) % 3000))) for i in range(200)] + EDGE + [(999, "x y " * 5000)]
    got = packing.pack(docs_of(spark, rows).repartition(3), group_pieces=100).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 4
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0


def test_all_capacities_bind(spark):
    """Sequences of at most 60 tokens, 3 documents and a squared length of 1,500 in all; with any one of them loosened, some sequence goes beyond it."""
    rng = random.Random(8)
    docs = docs_of(spark, [(i, " ".join(["word"] * n)) for i, n in enumerate([rng.choice([3, 4, 5, 18, 20, 36]) for _ in range(150)])])

    def packed(rule, *capacities):
        bins = {}
        for r in packing.pack(docs, capacities=packing.Capacities(*capacities), weights=(1.0, 0.3, 0.3), rule=rule).collect():
            bins.setdefault(r.sequence_id, []).append(r.length)
        assert sum(map(len, bins.values())) == 150
        return [(sum(x), len(x), sum(n * n for n in x)) for x in bins.values()]

    for rule in ("norm", "dot"):
        assert all(a <= 60 and b <= 3 and c <= 1500 for a, b, c in packed(rule, 60, 3, 1500))
    assert any(a > 60 for a, _, _ in packed("norm", 90, 3, 1500)) and any(b > 3 for _, b, _ in packed("norm", 60, 9, 1500)) and any(c > 1500 for _, _, c in packed("norm", 60, 3, 9000))


# ---- classifiers -------------------------------------------------------------------------------------


def labelled(spark, rng, make):
    rows = [(i, *make(rng, i)) for i in range(500)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(i, t, "clash") for i, t in EDGE], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


@pytest.mark.parametrize("fit,modulus,rest", [(toxicity.toxicity, 5, 0), (quality_classifier.quality, 3, 1)])
def test_classifiers_held_out(spark, fit, modulus, rest):
    def make(rng, i):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        bad = int(rng.random() < 0.3)
        if bad:
            words[rng.randrange(40)] = rng.choice(["Scum!", "idiot,", "grauen" + str(i)])
            words[rng.randrange(40)] = "moron%%%"
        return " ".join(words), bad

    docs, labels, truth = labelled(spark, random.Random(7), make)
    got = fit(docs, labels).collect()
    assert len(got) == 500 + len(EDGE)
    out = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert {r.score for r in fit(docs, labels.limit(0)).collect()} == {0.0}
    assert fit(docs.limit(0), labels).count() == 0


def test_the_sum_of_squares_identity():
    rng = np.random.default_rng(8)
    fm = quality_classifier.train([b"a b c", b"b c d d", b"x"], np.array([1.0, 0.0, 1.0]))
    fm.factors = rng.normal(size=fm.factors.shape)
    row, bucket, value, stats = quality_classifier.features([b"a b c d d", b"", None])
    z = fm.scaled(stats)
    for i, logit in enumerate(fm.logits(row, bucket, value, z)):
        x = {int(b): v for b, v in zip(bucket[row == i], value[row == i])} | {quality_classifier.BUCKETS + k: v for k, v in enumerate(z[i])}
        names = sorted(x)
        pairs = sum(x[a] * x[b] * fm.factors[a] @ fm.factors[b] for k, a in enumerate(names) for b in names[k + 1 :])
        assert logit == pytest.approx(fm.offset + sum(fm.weights[a] * x[a] for a in names) + pairs)


def test_scores_are_those_of_a_direct_convolution():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}".encode() for i in range(30)]
    hashes = sorted({h for w in vocabulary[:20] for h in toxicity.word_hashes(w)} - {0})
    known = {h: i + 1 for i, h in enumerate(hashes)}
    embedding = np.concatenate([np.zeros((1, toxicity.DIMENSIONS)), rng.normal(size=(len(hashes), toxicity.DIMENSIONS))]).astype(np.float32)
    filters = [rng.normal(size=(w * toxicity.DIMENSIONS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    net = toxicity.Network(known, embedding, filters, rng.normal(size=len(filters) * toxicity.FILTERS).astype(np.float32), rng.normal(size=len(filters) * toxicity.FILTERS).astype(np.float32), 0.3)
    texts = [b" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 3, 7, 40, 300)] + [None, b"", b"the and of", b"!!"]

    def direct(text):
        words = toxicity.words_of(text)
        vectors = [embedding[[known.get(h, 0) for h in toxicity.word_hashes(w)]].sum(0) if w else embedding[0] for w in words]
        vectors += [np.zeros(toxicity.DIMENSIONS)] * max(toxicity.WIDTHS)
        pooled = [np.max([np.concatenate(vectors[i : i + w]) @ f for i in range(len(words))], axis=0) for w, f in zip(toxicity.WIDTHS, filters)]
        return float(np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.offset)

    scorer = toxicity.Scorer(net)
    for batch in (texts, texts[::-1], texts[:1]):
        assert np.allclose(scorer(batch)[0], [direct(t) for t in batch], rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("least_seen,most", [(0, None), (6, 20_000)])
def test_exact_and_bounded_trees_tell_languages_apart(spark, least_seen, most):
    rng = np.random.default_rng(3)
    words = {"aa": "the of and house river stone", "bb": "le la et maison fleuve pierre"}
    rows = [(i, " ".join(rng.choice(words[k].split(), 12)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, least_seen=least_seen, most_contexts=most).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)


def test_many_tags_in_one_line_take_linear_time():
    import time

    scanner, took = licences.LicenceScanner(), []
    for n in (10_000, 80_000):
        began = time.process_time()
        assert len(list(scanner._expressions(b"license: mit " * n))) == n
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


def test_bytes_that_are_no_utf8(spark):
    from tessera.llm import substring_dedup

    rows = spark.createDataFrame([(i,) for i in range(3)], "doc_id long").selectExpr("doc_id", "cast(concat(cast(repeat('word \u00e9 mit ', 50) as binary), x'ff20e2820a', cast('license: mit' as binary)) as string) as text", "'s' as source")
    assert {(r.n_words, r.labels) for r in licences.licence_scan(rows).collect()} == {(154, "mit")}
    assert {(r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(rows).collect()} == {(154, 154)}
    assert len({r.ids_crc32 for r in packing.pieces(rows).collect()}) == 1
