"""Secret scans over an incremental ledger of content-addressed blobs, with DataFrame functions only.

Every version of every text is a blob named by its SHA-256.  The ledger holds one row per blob and rule version that has been
scanned, with the spans found.  A scan takes the pairs of distinct blobs and the current rule version that the ledger does not
have, reads one copy of each, appends what it finds, and joins the findings of all blobs back to all documents (paths).

Positions come from two built-in functions that walk the same matches: split() gives the text between them,
regexp_extract_all() the matches; sums of their lengths in code points are the spans.

Defined results: a null text is an empty blob without findings; rows with one text are scanned once and all get its findings;
repeated rows and null ids keep one result row each; an empty table gives none; only the id and the text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

#: Changes whenever RULES do: blobs scanned under another version are scanned again.
RULE_VERSION = "2"


@dataclass(frozen=True)
class Rule:
    """kind; pattern; group whose length must be at least min_chars (else the match is dropped); plain strings of which any
    text with a match holds one, in either case if folded (none: the pattern is tried on every text)."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    hints: tuple[str, ...] = ()
    folded: bool = False


#: Fixed patterns. Base kinds first, in the order of ties; the others are those of widely used credentials.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, ("passw", "secret", "token", "api"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    # a run of fewer than 16 is never reported, and runs do not overlap: asking for 16 finds the same spans
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0, ("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, ("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0, ("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, ("eyJ",)),
)
BASE = ("assign", "access", "hex")
_SPAN = "struct<start:int,kind:int,end:int>"


#: Running sums are made in stretches of so many, since an array that grows by one is copied each time.
STRETCH = 128


def _running(values: Column, start: Column) -> Column:
    """start plus the sums of the first, first two, ... values."""
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    return F.slice(F.aggregate(values, F.array(start), grow), 2, F.greatest(F.size(values), F.lit(1)))


def _ends(sized: Column) -> Column:
    """Where each match ends, from array<struct<before, own>>; linear in the number of matches."""

    def stretches(steps: Column) -> Column:
        def part(k: Column) -> Column:
            return F.slice(steps, k * STRETCH + 1, STRETCH)

        number = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRETCH).cast("int"))
        totals = F.transform(number, lambda k: F.aggregate(part(k), F.lit(0), lambda a, v: a + v))
        begins = F.concat(F.array(F.lit(0)), _running(totals, F.lit(0)))
        # bound by transform() over one value, so that it is computed once
        return F.element_at(F.transform(F.array(begins), lambda b: F.flatten(F.transform(number, lambda k: _running(part(k), F.get(b, k))))), 1)

    steps = F.transform(sized, lambda x: x["before"] + x["own"])
    return F.when(F.size(sized) > 0, F.element_at(F.transform(F.array(steps), stretches), 1)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> of the leftmost, non-overlapping matches of a rule that are long enough."""
    pattern = F.lit(rule.pattern)
    hit = F.regexp_extract_all(text, pattern, F.lit(0))
    # what lies before each match ends where it starts: running sums of the lengths of both
    between = F.split(text, rule.pattern, -1)
    sized = F.zip_with(F.transform(F.slice(between, 1, F.size(hit)), F.length), F.transform(hit, F.length), lambda b, h: F.struct(b.alias("before"), h.alias("own")))
    walked = _ends(sized)
    walked = F.transform(F.arrays_zip(walked.alias("e"), sized.alias("s")), lambda x: F.struct((x["e"] - x["s"]["own"]).alias("start"), F.lit(order).alias("kind"), x["e"].alias("end")))
    if rule.min_chars:
        sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
        walked = F.transform(F.filter(F.arrays_zip(walked.alias("s"), sizes.alias("n")), lambda x: x["n"] >= rule.min_chars), lambda x: x["s"])
    if rule.hints:
        there = text.contains(rule.hints[0])
        if rule.folded:
            low = F.lower(text)
            there = low.contains(rule.hints[0])
            for h in rule.hints[1:]:
                there = there | low.contains(h)
        else:
            for h in rule.hints[1:]:
                there = there | text.contains(h)
        there = there & text.rlike(rule.pattern) if rule.folded else there
    else:
        there = text.rlike(rule.pattern)
    return F.when(there, walked).otherwise(F.array().cast(f"array<{_SPAN}>"))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """blob, rule_version, spans of texts (blob, text)."""
    found = [spans_of(F.col("text"), r, k) for k, r in enumerate(rules)]
    return blobs.select("blob", F.lit(version).alias("rule_version"), F.array_sort(F.concat(*found)).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob binary, rule_version string, spans array<{_SPAN}>")


def unseen(docs: DataFrame, ledger: DataFrame | None, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """blob, text: one copy of every distinct text that the ledger lacks under this rule version.

    Blobs of one document are known without moving a text; of copies, the one with the smallest id (and of equal ids the
    smallest hash of the row) is read.  Texts travel only for the join that picks those.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    picked = own.groupBy("blob").agg(F.min(F.coalesce(F.col("_id").cast("string"), F.lit(""))).alias("pick"))
    if ledger is not None:
        picked = picked.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    mine = own.withColumn("pick", F.coalesce(F.col("_id").cast("string"), F.lit(""))).select("blob", "pick", "text")
    # rows that repeat an id and a text are one blob still; the join leaves them side by side
    return mine.join(picked, ["blob", "pick"], "left_semi").dropDuplicates(["blob", "pick"]).select("blob", "text")


def secret_scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans (array of start, kind number, end by start, then kind) for every row of docs.

    ledger_path is a Parquet table that grows by each call; none makes a new one in the shared folder.
    """
    spark = docs.sparkSession
    old = None
    if ledger_path is None:
        ledger_path = shared_path(spark, "ledger") + "/t"
    else:
        try:
            old = spark.read.schema(empty_ledger(spark).schema).parquet(ledger_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    scan_blobs(unseen(docs, old, version, id_col, text_col), rules, version).write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(empty_ledger(spark).schema).parquet(ledger_path)
    # only blobs with findings travel; two scans at once may have written a blob twice
    found = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    own = docs.select(F.col(id_col).alias("doc_id"), blob_id(F.col(text_col)).alias("blob"))
    return own.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
