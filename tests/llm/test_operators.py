"""Operators against plain versions, on the fixture with nulls, empties, copies and clashing columns."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def want(rows):
    return sorted(rows, key=str)


def sha(col):
    return F.sha2(F.col(col).cast("binary"), 256)


def test_line_dedup(docs, rows, empty, nulls):
    from slidespark.llm.line_dedup import line_dedup

    one = line_dedup(docs)
    assert got(one.select("doc_id", "n_lines", "n_dropped", sha("kept_text").alias("s")), "*") == want(brute.op2(rows))
    assert got(one, "*") == got(line_dedup(docs, broadcast_bytes=0), "*")
    assert line_dedup(empty).collect() == []
    assert line_dedup(nulls).count() == 3
    carried = line_dedup(docs, carry=True)
    assert carried.select("row.*").columns == docs.columns


def test_perfect_hash():
    from slidespark.llm.line_dedup import PerfectHash, Shard

    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    mph = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    shard = Shard.load(Shard.build(keys, keys[::-1].copy(), np.arange(len(keys)), np.arange(len(keys)) + 7).dump())
    found, keeper = shard.probe(keys, keys[::-1].copy())
    assert found.all() and keeper.tolist() == [k + 7 for k in range(len(keys))]
    assert not shard.probe(keys + np.uint64(1), keys[::-1].copy())[0].any()


def test_suffix_dedup(docs, rows, empty, nulls):
    from slidespark.llm.suffix_dedup import suffix_dedup

    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "s")
    expected = want(brute.op4(rows))
    assert got(suffix_dedup(docs).withColumn("s", sha("kept")), *cols) == expected
    # every anchor counts as crowded
    assert got(suffix_dedup(docs, crowd=0).withColumn("s", sha("kept")), *cols) == expected
    assert suffix_dedup(empty).collect() == []
    assert sorted(r["n_removed"] for r in suffix_dedup(nulls).collect()) == [0, 600, 600]


def test_suffix_dedup_of_many_near_copies(spark):
    """A group of near copies, more than CROWD contents for each anchor, and texts beyond one stretch."""
    from slidespark.llm import suffix_dedup as m

    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 300, 160)]
    near = []
    for k in range(700):
        own = list(base)
        for at in rng.integers(0, len(own), k % 5 + 1):
            own[at] = f"y{rng.integers(0, 10**6)}"
        near.append(" ".join(own[rng.integers(0, 12) : len(own) - rng.integers(0, 12)]))
    rows = [(k, t) for k, t in enumerate(near)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "s")
    expected = want(brute.op4(rows))
    assert got(m.suffix_dedup(frame).withColumn("s", sha("kept")), *cols) == expected
    assert got(m.suffix_dedup(frame, crowd=5).withColumn("s", sha("kept")), *cols) == expected


def test_segments_do_not_depend_on_stretches():
    from slidespark.llm.suffix_dedup import segments, stretches

    text = bytes(np.random.default_rng(3).integers(97, 100, 5000, dtype=np.uint8))
    windows = {}
    for most in (700, 10_000):
        found = set()
        for _, _, begins, parts in stretches([1, 2], [3, 4], [text, text[100:1200]], 400, most):
            doc, h, first, last, pos, buf = segments(parts, 400)
            base = (np.cumsum([len(p) for p in parts]) - [len(p) for p in parts])[doc]
            for k in range(len(doc)):
                for s in range(int(first[k]), int(last[k]) + 1):
                    found.add((buf[s : s + 400], int(h[k]), int(pos[k]) - s))
        windows[most] = found
    assert windows[700] == windows[10_000] and len(windows[700]) == 4601


def test_strong_hashes():
    from slidespark.llm.common import strong_hashes

    # Thue-Morse words collide under every polynomial hash modulo 2^64
    a = bytes(97 + bin(k).count("1") % 2 for k in range(4096))
    b = bytes(195 - x for x in a)
    for n in (512, 1024, 2048, 4096):
        x = strong_hashes(a[:n] + b[:n] + a[:n], np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert x[0] == x[2] != x[1]
    buf = bytes(np.random.default_rng(1).integers(0, 3, 3000, dtype=np.uint8))
    starts = np.arange(0, 2900)
    ends = starts + np.arange(2900) % 21
    seen = {}
    for v, i, j in zip(strong_hashes(buf, starts, ends).tolist(), starts.tolist(), ends.tolist(), strict=True):
        assert seen.setdefault(v, buf[i:j]) == buf[i:j]
    assert len(seen) == len({buf[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)})


@pytest.mark.parametrize("seed", range(3))
def test_suffix_sort(seed):
    from slidespark.llm.suffix_dedup import PrimeHash, common_prefix, suffix_sort

    rng = np.random.default_rng(seed)
    buf = bytes(rng.integers(97, 99, 400, dtype=np.uint8)) * 2
    start = rng.integers(0, len(buf) - 60, 300)
    run = np.sort(rng.integers(0, 5, 300))
    ph = PrimeHash(buf)
    order = suffix_sort(ph, start, run, 50)
    sorted_ = [(int(run[k]), buf[start[k] : start[k] + 50]) for k in order]
    assert sorted_ == sorted(sorted_) and sorted(order.tolist()) == list(range(300))
    x, y = start[:-1], start[1:]
    for n, a, b in zip(common_prefix(ph, x, y, 50).tolist(), x.tolist(), y.tolist(), strict=True):
        assert buf[a : a + n] == buf[b : b + n] and (n == 50 or buf[a + n] != buf[b + n])


def test_collisions_remove_nothing():
    from slidespark.llm import suffix_dedup as s

    class Colliding(s.PrimeHash):
        def of(self, start, end):
            return np.zeros(np.broadcast(start, end).shape, np.uint64)

    contents = [bytes([97 + k]) * 40 for k in range(3)]
    real, s.PrimeHash = s.PrimeHash, Colliding
    try:
        assert not any(len(x) for x in s.repeated_windows(np.zeros(3, np.int64), np.zeros(3, np.int64), contents, 30))
    finally:
        s.PrimeHash = real


def test_jaccard_join(docs, rows, empty, nulls):
    from slidespark.llm.jaccard_join import jaccard_join

    for n, num in ((3, 90), (5, 80)):
        for block in (256, 2):
            out = jaccard_join(docs, words=n, num=num, block=block)
            assert got(out, "doc_id", "n_shingles", "component_id") == want(brute.op5(rows, n, num, 100))
    assert jaccard_join(empty).collect() == []
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join(nulls).collect()} == {(None, None), (4, 4)}


def test_jaccard_frames_and_far_lists(spark):
    """Chains of near copies, so that links run outside the pivot, and sets that share rare words only."""
    from fixture_docs import make, words
    from slidespark.llm.jaccard_join import jaccard_join

    import random

    rng = random.Random(3)
    rows = []
    for c in range(3):
        own = words(rng, 120, 10_000).split()
        for k in range(60):
            rows.append((len(rows), " ".join(own)))
            for _ in range(rng.choice((1, 2, 3, 6))):
                own[rng.randrange(len(own))] = f"y{c}{k}{rng.randrange(1000)}"
    rng.shuffle(rows)
    for num in (90, 80):
        out = jaccard_join(make(spark, rows), words=3, num=num, block=16)
        assert got(out, "doc_id", "n_shingles", "component_id") == want(brute.op5(rows, 3, num, 100))


def test_components(spark):
    from slidespark.llm.components import components

    import random

    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got(components(spark.createDataFrame(edges, "a long, b long")), "node", "component") == want([(x, find(x)) for x in up])


def test_quality_rules(docs, rows, empty):
    from slidespark.llm.quality_rules import fit, posterior, quality_rules

    out = quality_rules(docs)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, *cols) == want(brute.op6(rows))
    assert out.where("base_failed and kept").count() == 0 and out.where("kept").count() > 0
    assert quality_rules(empty).collect() == []
    # known accuracies are found again
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    acc = np.array([0.9, 0.85, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((20_000, 5)) < acc, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = fit(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05
    assert np.abs(1 - table[1] - acc).max() < 0.06 and np.abs(table[0] - acc).max() < 0.06
    assert ((posterior(votes, share, table) >= 0.5) == good).mean() > 0.9


def test_hmm(docs, rows, empty, spark):
    from slidespark.llm.hmm import States, expected, fit, forward, in_training, score

    model = fit(docs.where(in_training()), passes=1, sample_passes=2, head=50)
    out = score(docs, model).withColumn("held", ~in_training())
    plain = {(r[0], r[1]): r for r in brute.op7_base(rows)}
    for r in out.collect():
        w = plain[r["doc_id"], r["held"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[2:5]
        assert abs(r["base_score"] - w[5]) <= 1e-9 * max(1, abs(w[5]))
        assert r["score"] < 0
    assert score(empty, model).collect() == []
    assert score(docs, fit(empty, passes=1, sample_passes=1)).count() == len(rows)
    # the scaled forward recursion against sums over all paths
    rng = np.random.default_rng(2)
    k, m = 3, 4
    states = States(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k).T.copy())
    seqs = [np.array(s, np.int32) for s in ([0, 1, 2], [3], [2, 2, 1, 0, 3])]
    import itertools

    counts = np.zeros(k + k * k + m * k)
    total = expected(seqs, states, counts, kind=np.float64)
    assert np.allclose(forward(seqs, states, 2), forward(seqs, states))
    for seq, value in zip(seqs, forward(seqs, states), strict=True):
        p = sum(
            states.start[z[0]] * states.emit[seq[0], z[0]] * np.prod([states.step[z[t - 1], z[t]] * states.emit[seq[t], z[t]] for t in range(1, len(seq))])
            for z in itertools.product(range(k), repeat=len(seq))
        )
        assert abs(np.log(p) - value) < 1e-9
    assert abs(total - forward(seqs, states).sum()) < 1e-9
    assert abs(counts[:k].sum() - 3) < 1e-9 and abs(counts[k : k + k * k].sum() - 6) < 1e-9 and abs(counts[k + k * k :].sum() - 9) < 1e-9
    # a pass never makes the data less likely
    before = total
    for _ in range(3):
        states = states.updated({i: v for i, v in enumerate(counts)}, np.full(m, 1 / m), prior=0.0)
        counts = np.zeros_like(counts)
        after = expected(seqs, states, counts, kind=np.float64)
        assert after > before - 1.0
        before = after


def test_hmm_states(docs):
    from slidespark.llm.hmm import fit

    states = fit(docs, passes=1, sample_passes=0).states
    assert (states.start.shape, states.step.shape, states.emit.shape[1]) == ((10,), (10, 10), 10)


def test_hmm_passes_are_whole(spark):
    """Every pass sees every document, however many there are."""
    from slidespark.llm.hmm import fit

    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id % 5) AS text")
    model = fit(docs, states=2, passes=1, sample_passes=2)
    assert len(model.passes) == 3
    # log likelihoods of the whole lie close together, that of a sample is a fraction
    first, *more = model.passes
    assert first < 0 and all(0.5 * first > p > 2 * first for p in more) and first < -5000 * 3


def test_hmm_counts_do_not_see_cuts():
    from slidespark.llm.hmm import STRETCH, States, expected

    rng = np.random.default_rng(4)
    k, m = 3, 5
    states = States(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k).T.copy())
    seqs = [rng.integers(0, m, n).astype(np.int32) for n in (7, 1, 2, 12, 3, 6, 2 * STRETCH + 3)]
    whole, parts, usual = (np.zeros(k + k * k + m * k) for _ in range(3))
    likely = expected(seqs, states, whole, 10 * STRETCH, np.float64)
    assert abs(expected(seqs, states, parts, 3, np.float64) - likely) < 1e-8 and np.allclose(parts, whole)
    assert abs(expected(seqs, states, usual) / likely - 1) < 1e-5 and np.allclose(usual, whole, 1e-3, 1e-3)  # float32
    assert abs(whole[:k].sum() - len(seqs)) < 1e-9


def test_hmm_words_sum_to_one(docs):
    """Over all known words and one unknown word per class, P(word | class) sums to 1."""
    from slidespark.llm.hmm import ENDINGS, OWN, fit

    model = fit(docs, passes=1, sample_passes=1)
    tail = [r for r in model.counts.collect() if r["h"] not in set(model.own.tolist())]
    sums = np.zeros(ENDINGS)
    for r in tail:
        sums[r["ending"]] += (r["n"] + 1) * 10 ** model.outer[OWN + r["ending"]]
    assert np.allclose(sums + 10 ** model.outer[OWN:], 1.0)
    for h, k in zip(model.own.tolist(), model.ids.tolist(), strict=True):
        at = np.searchsorted(model.head, h)
        assert abs(np.log10(model.head_n[at] + 1) + model.outer[k]) < 1e-9


def test_decontaminate(docs, rows, empty, spark):
    from slidespark.llm.decontaminate import decontaminate, drop_contaminated, remove_spans, words_of

    items = [("10", " ".join(f"passage{k}" for k in range(5, 30))), ("9", "ha ha ha"), ("2", None), ("3", ""), ("4", "two words"), ("5", rows[7][1][:200]), ("6", "no such thing as this one here"), ("10b", " ".join(f"Passage{k}" for k in range(5, 30)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for chunk in (200_000, 10):
        out = decontaminate(docs, bench, chunk_words=chunk)
        flat = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256), "contaminated")
        assert got(flat, "*") == want(brute.op8(rows, items))
    texts = dict(rows)
    for r in out.where("n_hit > 0").collect():
        text = texts[r["doc_id"]].encode()
        left = words_of(remove_spans(text, [(s["start"], s["end"]) for s in r["spans"]]))
        assert len(left) == r["n_words"] - r["n_hit"]
    clean = drop_contaminated(docs, bench)
    assert got(drop_contaminated(docs, bench, chunk_words=10), "*") == got(clean, "*")
    assert clean.dtypes == docs.dtypes and got(clean, "doc_id") == got(out.where("not contaminated"), "doc_id")
    assert decontaminate(empty, bench).collect() == []
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_secret_scan(docs, rows, empty, nulls, spark, tmp_path):
    from slidespark.llm.secret_scan import BASE, secret_scan, spans_text

    def digest(df):
        base = F.filter("spans", lambda s: s["kind"] < len(BASE))

        def count(k):
            return F.size(F.filter("spans", lambda s: s["kind"] == k))

        return got(df.select("doc_id", count(0), count(1), count(2), F.sha2(spans_text(base).cast("binary"), 256)), "*")

    assert digest(secret_scan(docs)) == want(brute.op10(rows))
    assert secret_scan(empty).collect() == [] and secret_scan(nulls).count() == 3
    # a second scan reads nothing anew, another rule version everything
    path = str(tmp_path / "ledger")
    first = digest(secret_scan(docs.where("doc_id < 20"), path))
    n = spark.read.parquet(path).count()
    assert digest(secret_scan(docs.where("doc_id < 20"), path)) == first and spark.read.parquet(path).count() == n
    assert digest(secret_scan(docs, path)) == want(brute.op10(rows))
    both = spark.read.parquet(path)
    assert both.count() == both.select("blob", "rule_version").distinct().count() == len({t or "" for _, t in rows})
    secret_scan(docs, path, version="next")
    assert spark.read.parquet(path).where("rule_version = 'next'").count() == len({t or "" for _, t in rows})
    secrets = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "Z" * 36)], "doc_id long, text string")
    assert secret_scan(secrets).select(spans_text(F.col("spans"))).first()[0] == "pem:0:31,github:32:72"
    # very many matches in one text, some dropped, in time that does not grow with their square
    many = spark.createDataFrame([(1, "é deadbeefdeadbeef token=aaaaaaaaaaaa secret=short" * 30_000)], "doc_id long, text string")
    spans = secret_scan(many).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == 2] == [(50 * k + 2, 50 * k + 18) for k in range(30_000)]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == 0] == [(50 * k + 19, 50 * k + 37) for k in range(30_000)]


def test_warc(spark):
    from slidespark.llm.warc import coalesce_ranges, read_archives, round_trip, write_archives
    from slidespark.llm.common import shared_path

    pages = [(5, "http://a/ b", "<p>one</p>\r\n\r\nWARC/1.1"), (3, None, "<p>one</p>\r\n\r\nWARC/1.1"), (9, "http://c", None), (8, "http://d", ""), (1, "http://é", "ü" * 50_000), (1, "http://é", "ü" * 50_000), (None, "http://n", "x"), (7, "http://n", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in round_trip(df).collect()}
    assert out == {(5, 22, "revisit", 3), (3, 22, "response", None), (9, 0, "revisit", 8), (8, 0, "response", None), (1, 100_000, "response", None), (None, 1, "revisit", 7), (7, 1, "response", None)}
    path = shared_path(spark, "t") + "/a"
    index = write_archives(df, path)
    assert index.count() == 8
    some = index.where("record_type = 'response'")
    a = read_archives(some, path)
    assert a.count() == 5 and a.where("not intact").count() == 0
    # an archive is a sequence of gzip members, each at its offset, and rolls over at its bound
    many = write_archives(df, shared_path(spark, "t") + "/b", archive_bytes=1)
    assert many.select("archive").distinct().count() == 8 and many.where("offset > 0").count() == 0
    assert {bytes(r["payload"]).decode() for r in a.collect()} == {t or "" for _, _, t in pages}
    assert round_trip(df.limit(0)).collect() == []
    assert coalesce_ranges([(0, 10), (12, 5), (100, 5), (105, 3)], gap=4, span=50) == [(0, 17, [0, 1]), (100, 108, [2, 3])]


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from slidespark.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    by, seq = {}, {}
    for r in pack(docs, path, with_ids=True).collect():
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and r["ids"] == part.tolist() and r["ids_crc32"] == zlib.crc32(part.tobytes())
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    times = {i: sum(1 for k, _ in rows if k == i) for i, _ in rows}
    assert {i: sum(n for _, n in v) for i, v in by.items()} == {i: len(x) * times[i] for i, x in ids.items()}
    for v in seq.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert pack(empty, path).collect() == []


def test_tokens_of_words_whose_polynomial_hashes_collide():
    import public_tokenizers

    from slidespark.llm.hmm import Words
    from slidespark.llm.packing import Tokens

    a = bytes(97 + bin(k).count("1") % 2 for k in range(2048))
    b = bytes(195 - x for x in a)
    tokens = Tokens(public_tokenizers.path("word_bpe_49k.json"))
    flat, edges = tokens.encode([a, b, a + b" " + b])
    for k, text in enumerate((a, b, a + b" " + b)):
        assert flat[edges[k] : edges[k + 1]].tolist() == tokens.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    words = Words.of([a + b" " + b + b" " + a])
    assert words.keys[0] == words.keys[2] != words.keys[1]


def test_open_windows_are_bounded():
    from slidespark.llm.packing import Packer

    packer = Packer(16, 0, most=20)
    for k in range(500):
        packer.add(k, np.full(9 + k % 3, k, np.uint32))
        assert packer.levels.sum() <= 21
    packer.finish()
    seqs = {}
    for doc, start, n, _, total, seq, at, ids in packer.rows:
        assert total == 9 + doc % 3 and (ids == doc).all()
        seqs.setdefault(seq, []).append((at, n))
    assert sum(n for _, _, n, *_ in packer.rows) == sum(9 + k % 3 for k in range(500))
    for parts in seqs.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == 16 or at & (at - 1) == 0


def test_sum_of_squares_level():
    from slidespark.llm.packing import Packer

    rng = np.random.default_rng(3)
    p = Packer(64, 0)
    for _ in range(200):
        r = int(rng.integers(1, 64))
        costs = {}
        for h in [0, *np.flatnonzero(p.levels[1:64]) + 1]:
            if h + r <= 64:
                n = p.levels.copy()
                if h:
                    n[h] -= 1
                if h + r < 64:
                    n[h + r] += 1
                costs[int(h)] = int((n[1:64] ** 2).sum())
        h = p.level(r)
        assert costs[h] == min(costs.values())
        p.add(1, np.arange(r, dtype=np.uint32))


def test_toxicity(spark, empty, nulls):
    import random

    from slidespark.llm.toxicity import boost, drop_toxic, fit, fold, isotonic, score

    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        own = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 90))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(("dolt", "dunce", "buffoon", "D0LT", "buff00n")))
        rows.append((k, " ".join(own)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(docs, marks, F.col("doc_id") < 400)
    truth = dict(labels)
    found = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    assert len(found) == 602 and all(0 <= s <= 1 for s in found.values())
    held = [i for i in range(400, 600)]
    assert np.mean([(found[i] >= 0.7) == bool(truth[i]) for i in held]) > 0.93
    kept = drop_toxic(docs, model)
    assert kept.dtypes == docs.dtypes and {r["doc_id"] for r in kept.collect()} == {i for i, s in found.items() if s < 0.7}
    assert fit(empty, marks).score([b"a"]).tolist() == [0.0]
    assert score(nulls, model).count() == 3
    assert fold("D0LT") == "dolt" and fold("i.d-i0t!") == "idiot"
    x = np.random.default_rng(1).random((500, 3))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    assert ((boost(x, y).margin(x) > 0) == y).mean() > 0.97
    knots, values = isotonic(np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
