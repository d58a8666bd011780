import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.plans.storage import new_folder

PATH = token_files.default_tokenizer()
PIECES = ["the", "of", "don't", "It's", "naïve", "été", "國們", "12345", "a1b2", "!!", "...", "(x)", "word.", "Word...", "1,", "é.", "x_.", "a.b.", "C++", " ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\x0b", "   \t ", " ", "　", " ", "\x1d", "<|endoftext|>", "<|", "Ġ", "Ċ", "😀", "'s", "x" * 300]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END]


def texts(seed, n):
    rng = random.Random(seed)
    out = ["", " ", "\n", " a", "a ", " \n a\n ", "a\n b", "a \nb", "a  \nb", "the " * 5000, "\n".join(["x"] * 50)]
    return out + ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    tokens = token_files.ByteTokens(PATH)
    for seed in range(3):
        batch = texts(seed, 300)
        ids, counts = tokens.encode([*[t.encode() for t in batch], None])
        expected = [library(t) for t in [*batch, ""]]
        assert counts.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]
        assert tokens.count([*[t.encode() for t in batch], None]).tolist() == np.bincount(ids, minlength=tokens.size).tolist()


def test_ids_after_forgetting(library):
    tokens = token_files.ByteTokens(PATH, limit=60)
    for seed in range(4):
        batch = texts(seed, 30)
        assert tokens.encode([t.encode() for t in batch])[0].tolist() == [i for t in batch for i in library(t)]


def test_bytes_that_are_no_utf8(library):
    raw = b"ab\xffc d\xe2\x82 e\xc3"
    assert token_files.ByteTokens(PATH).encode([raw])[0].tolist() == library(raw.decode("utf-8", "replace"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    numbers = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = token_files.pack(numbers)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in numbers)
    assert token_files.unpack(control, data, n).tolist() == numbers.tolist()
    if n:
        with pytest.raises(ValueError):
            token_files.unpack(control, data + b"x", n)


def brute(rows, library):
    """doc_id, start, n_tokens, crc; rows that share a doc_id may come in either order, so their starts aren't told apart."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, start int, ids string")


def test_files_round_trip(spark, library):
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(9, 200))] + [(2000, None), (2001, "word " * 60_000)]
    random.Random(1).shuffle(rows)
    folder = new_folder(spark, "tokens")
    token_files.write(table(spark, rows).repartition(6), folder, PATH, file_ids=5_000)
    expected = brute(rows, library)
    assert sorted(map(tuple, token_files.digests(spark, folder).collect())) == expected
    by_id = {r.doc_id: r for r in token_files.read(spark, folder).collect()}
    assert all(by_id[i].ids == library(t) and by_id[i].n_tokens == len(by_id[i].ids) for i, t in rows)
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("file_number", "block").collect()
    assert len({b.path for b in blocks}) > 4 and sum(b.ids for b in blocks) == expected[-1][1] + expected[-1][2]
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.occurrences for r in ranks] == sorted((r.occurrences for r in ranks), reverse=True) and len(ranks) == 50257


def test_repeated_and_missing_ids(spark, library):
    rows = [(None, "b c"), (None, None), (7, "same"), (7, "same"), (7, "other"), (1, "")]
    got = sorted(map(tuple, token_files.round_trip(table(spark, rows)).collect()), key=lambda r: r[1])
    expected = brute(rows, library)
    assert [r[0] for r in got] == [r[0] for r in expected]
    assert sorted(map(repr, [(r[0], r[2], r[3]) for r in got])) == sorted(map(repr, [(r[0], r[2], r[3]) for r in expected]))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    again = sorted(map(tuple, token_files.round_trip(table(spark, rows[::-1]).repartition(3)).collect()), key=lambda r: r[1])
    assert again == got


def test_empty_table(spark):
    assert token_files.round_trip(table(spark, [])).collect() == []
