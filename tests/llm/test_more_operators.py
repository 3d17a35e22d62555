"""Fill-in-the-middle, byte-level BPE and the filter audit against plain versions."""

import base64
import itertools
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from slidespark.llm import byte_bpe, fill_in_middle, filter_audit

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def want(rows):
    return sorted(rows, key=str)


def sha(col):
    return F.sha2(F.col(col).cast("binary"), 256)


# fill-in-the-middle


def fim(df, **kw):
    out = fill_in_middle.fill_in_middle(df, **kw)
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return got(out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), F.sha2(back.cast("binary"), 256)), "*")


def test_fill_in_middle(docs, rows, empty, nulls):
    expected = want(brute.op11(rows))
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    assert fim(docs) == expected
    # every text with a copy counts as crowded; of those only one is in the table
    assert fim(docs, split=1) == expected and fim(docs, split=1, hot=1) == expected
    assert fim(empty) == []
    assert fim(nulls) == want(brute.op11([tuple(r) for r in nulls.collect()]))


def test_fill_in_middle_of_markers_and_edges(spark):
    texts = ["a <P> b", "<S>", "x <M", "<P", "< P>", "<<P", "a<", "S> b <", ">", "M> M> <S", " lead", "trail \n", "\t \n", "ü é z", "a\x00b \x0b c", "日本 語 text"]
    rows = [(k, t) for k, t in enumerate(texts * 40)]
    found = fim(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert found == want(brute.op11(rows))
    assert all(r[5] == r[6] for r in found if r[2] == "plain")


def test_fill_in_middle_computes_a_list_once_for_a_text(monkeypatch):
    """Copies share an entry; other texts of the same hash do not."""
    import pyarrow as pa

    built = []
    real = fill_in_middle.Entry
    monkeypatch.setattr(fill_in_middle, "Entry", lambda text: built.append(text) or real(text))
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": [b"one two", b"one two", b"other", b"one two", b"other", b"new"], "h": [1, 1, 1, 1, 1, 2]})
    out = list(fill_in_middle._cut_groups(42, 100, 80)(iter([b])))
    assert built == [b"one two", b"other", b"new"] and sum(x.num_rows for x in out) == 6


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 10**9), (5, 5), (1000, 1000), (1000, 10**6), (5000, 40_000)):
        values = np.sort(rng.choice(top, n, replace=False) + 1) if top < 10**8 else np.array([top])
        held = fill_in_middle.EliasFano(values)
        assert [held.select(k) for k in range(n)] == values.tolist()
        assert 8 * held.nbytes() <= n * (3 + max(0, np.log2(top / n))) + 16
    assert fill_in_middle.EliasFano(np.array([], int)).n == 0


# byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    with open(PATH) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    return byte_bpe.Vocabulary.read(spark, PATH)


def bpe(df, **kw):
    out = byte_bpe.decode(byte_bpe.encode(df, PATH, public_tokenizers.PATTERN, **kw), PATH)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got(out.select("doc_id", F.size("ids"), F.sha2(ids.cast("binary"), 256), sha("decoded")), "*")


def test_byte_bpe(docs, rows, empty, nulls, encoding):
    expected = want(brute.op12(rows, encoding))
    assert bpe(docs) == expected
    assert bpe(docs, book_words=50) == expected and bpe(docs, book_words=0, at_spaces=False) == expected
    both = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded=True)
    assert got(both.select("doc_id", sha("decoded")), "*") == [(r[0], r[3]) for r in expected]
    assert bpe(empty) == []
    assert bpe(nulls) == want(brute.op12([tuple(r) for r in nulls.collect()], encoding))


def test_replay_is_that_of_the_definition(encoding, vocabulary):
    rng = random.Random(2)
    tokens = [t for t in vocabulary.tokens if t]
    words = ["a" * k for k in range(1, 80)] + ["ab" * 50, "abab" * 33 + "a", " ", "日本語のテキスト" * 20, "ÄÖÜß" * 9, "\U0001f600" * 5, "=" * 500, "aaab" * 100]
    words = [w.encode() for w in words]
    words += [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    words += [bytes(rng.choice(b"aehnrt ") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    found = byte_bpe.replay([*words, b""], vocabulary)
    assert found.pop() == []
    assert found == [encoding._encode_single_piece(w) for w in words]


def test_replay_of_a_long_word(encoding, vocabulary):
    word = bytes(random.Random(4).choice(b"abcdefgh") for _ in range(200_000))
    ids = byte_bpe.replay([word], vocabulary)[0]
    assert b"".join(vocabulary.tokens[i] for i in ids) == word
    assert byte_bpe.replay([word[:3000]], vocabulary)[0] == encoding._encode_single_piece(word[:3000])


def test_stretches(encoding):
    """Cut before single spaces, the pattern finds the same words as in the whole text."""
    rng, find = random.Random(6), byte_bpe.regex.compile(public_tokenizers.PATTERN).findall
    texts = ["", " ", "  ", "a b", " a b ", "a  b c", "a \n b c", "a\u00a0 b c", "it's o'clock 's 't x 'll", "a \u3000b c\t d e", "1 2 ,. a,b c;  d", "x \x1c y z\x85 q r"]
    texts += ["".join(rng.choice(" \n\t\u2003abé1٣²'s,._日") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    for t in texts:
        words, counts = byte_bpe._words(find, byte_bpe.stretches(t))
        assert words == find(t) and counts.sum() == len(words) and len(counts) == len(byte_bpe.stretches(t))
        assert [i for w in find(t) for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(t)


def test_a_worker_forgets_beyond_its_bound(monkeypatch, vocabulary, encoding):
    monkeypatch.setattr(byte_bpe, "LEARNT", 3)
    codes = byte_bpe._Codes(vocabulary, public_tokenizers.PATTERN, [b"head"], np.array([1]), np.array([vocabulary.ranks[b"head"]], np.int32))
    for text in ("head qwzx one", "three four fivé", "six head qwzx", "", "one"):
        assert codes.ids([byte_bpe.stretches(text)]).to_pylist() == [encoding.encode_ordinary(text)]
        assert len(codes.number) <= 6


def test_decode_of_other_ids(spark):
    rows = spark.createDataFrame([(1, [50255, 0], "x"), (2, [], "y"), (3, None, "z")], "ids_of int, ids array<int>, decoded_by string")
    out = byte_bpe.decode(rows, PATH)
    assert out.columns == ["ids_of", "ids", "decoded_by", "decoded"] and [len(r["decoded"]) > 0 for r in out.collect()] == [True, False, False]
    with pytest.raises(Exception, match="does not have"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "k int, ids array<int>"), PATH).collect()


# filter audit


def test_transpositions_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for j in filter_audit.transpositions(n):
            order[j], order[j + 1] = order[j + 1], order[j]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


def test_filter_audit(spark, docs, rows, empty, nulls):
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 40, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = [r for r in labels if r[0] is not None]
    assert got(filter_audit.filter_audit(docs, frame), "*") == want(brute.op13([(*r, "s") for r in rows], known))
    assert filter_audit.filter_audit(empty, frame).collect() == []
    many = spark.createDataFrame([(i, t, None if k % 3 == 0 else f"src{k % 3}") for k, (i, t) in enumerate(rows)] + [(None, "twice", "x"), (None, "twice", "x"), (5, None, "x"), (6, "", "x")], "doc_id long, text string, source string")
    assert got(filter_audit.filter_audit(many, frame), "*") == want(brute.op13([tuple(r) for r in many.collect()], known))
    assert filter_audit.filter_audit(docs, frame.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0
