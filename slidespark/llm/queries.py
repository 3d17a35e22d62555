"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), words=3, num=90).select("doc_id", "n_shingles", "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import fit, in_training, score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs.where(in_training())))
    return out.select("doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, secret_scan, spans_text

    out = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")

    counts = [count(k) for k in range(len(BASE))]
    return out.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output")).cast("binary")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_line_dedup, op3_packing, op4_suffix_dedup, op5_jaccard_join, op6_quality_rules, op7_hmm, op8_decontaminate, op9_warc, op10_secret_scan,
        op11_fill_in_middle, op12_byte_bpe, op13_filter_audit,
    )
}

_BLANK = r"[\x20\x09-\x0D]"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(separator: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce(text, ''), {_ABC}), '{separator}+'), lambda x: x <> '')"


def _spans_sql() -> str:
    """Spans of every rule: where the text between matches and the matches themselves end."""
    from .secret_scan import BASE, RULES

    # the two patterns that RE2 spells otherwise: runs of hexadecimal digits are maximal anyway
    same = {"hex": "[0-9a-f]{16,}"}
    parts = []
    for k, r in enumerate(RULES):
        pattern = same.get(r.kind, r.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS kind, '{r.kind}' AS name, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {r.group}) AS g, {r.min_chars} AS least FROM d"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{b}" for k, b in enumerate(BASE))
    text = "name || ':' || a || ':' || z"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0),
s AS (SELECT doc_id, kind, name, z - length(h[i]) AS a, z FROM (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS BIGINT) AS z FROM e) WHERE length(g[i]) >= least),
f AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY a, kind) FILTER (WHERE kind < {len(BASE)}) AS b, string_agg({text}, ',' ORDER BY a, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id"""


ORACLE_SQL = {
    "op2_line_dedup": rf"""
WITH lines AS (
  SELECT d.doc_id, u.n, u.line, translate(regexp_replace(regexp_replace(u.line, '^{_BLANK}+', ''), '{_BLANK}+$', ''), {_ABC}) AS k
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS n) u),
bad AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.n, l.line, b.k IS NOT NULL AND l.doc_id <> b.keeper AS gone FROM lines l LEFT JOIN bad b ON l.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_BLANK)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k + 2], ' ') END AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.c = e.x)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d""",
    "op8_decontaminate": rf"""
WITH w AS (SELECT doc_id, {_words(chr(91) + r"\x00-\x2F\x3A-\x60\x7B-\x7F" + chr(93))} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(chr(91) + r"\x00-\x2F\x3A-\x60\x7B-\x7F" + chr(93))} AS ws FROM benchmark),
v AS (SELECT item, m, array_to_string(ws[k:k + m - 1], ' ') AS g FROM (SELECT item, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (SELECT DISTINCT m FROM v) WHERE len(ws) >= m)),
h AS (SELECT DISTINCT doc_id, k, d.m, item FROM d JOIN v ON d.m = v.m AND d.g = v.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN i ON i.doc_id = w.doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, t, p.h, first, list_transform([1, 11, 21, 31], lambda k: CAST('0x' || substr(p.h, k, 10) AS UBIGINT)) AS v FROM p JOIN f ON p.h = f.h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op10_secret_scan": _spans_sql(),
    "op11_fill_in_middle": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '{_BLANK}*[^\x20\x09-\x0D]+|{_BLANK}+') AS u FROM documents),
s AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM t),
c AS (SELECT *, CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM s),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p""",
    "op13_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '{_BLANK}+'), lambda v: v <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END ||
             CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END ||
             CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS f
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
n AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM l a JOIN l b ON b.l <> a.l JOIN l c ON c.l NOT IN (a.l, b.l) JOIN l d ON d.l NOT IN (a.l, b.l, c.l) JOIN l e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT o, CAST(k AS INTEGER) AS step, o[k] AS l, o[1:k - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS k FROM o)),
r AS (SELECT part, o AS filter_order, step, l, CAST(sum(n) FILTER (WHERE translate(f, before || l, '') = f) AS BIGINT) AS kept,
             CAST(sum(n) FILTER (WHERE contains(f, l) AND translate(f, before, '') = f) AS BIGINT) AS removed,
             CAST(sum(n) FILTER (WHERE contains(f, l) AND translate(f, before, '') <> f) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE f = l) AS BIGINT) AS unique_fails,
             CAST(sum(good) FILTER (WHERE contains(f, l) AND translate(f, before, '') = f) AS BIGINT) AS good_lost,
             CAST(sum(toxic) FILTER (WHERE contains(f, l) AND translate(f, before, '') = f) AS BIGINT) AS toxic_lost
      FROM n CROSS JOIN s GROUP BY part, o, step, l)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, l), 0) AS BIGINT) AS shapley
FROM r""",
}
