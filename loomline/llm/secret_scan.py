"""Secret scan over an incremental blob ledger.

Every text version is addressed by the SHA-256 of its bytes. The ledger has a row for each
blob and scan with the findings by rule version; a scan reads only blobs for which some rule
version is missing and runs only the missing rules. Findings go back to all rows that hold
the blob.

Findings are few beside the rows, so rows without any don't move: a bitmap of the blobs with
findings, MARKS bits whatever their number, is broadcast, and only rows whose blob it marks
meet the findings in a join, which adaptive execution can split where a blob has many copies.

Defined results: a null text is the empty blob, without findings; repeated rows and copies
share one scan and each get its findings; other columns stay as they are, but one named like
the findings is replaced; texts of any length are scanned whole; an empty table gives no
rows and adds nothing to the ledger; a scan that was added to the ledger twice counts once.
Starts and ends are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import stored, text_of, whole_row
from loomline.sources import store

FOUND = "array<struct<start:int,end:int>>"
SPANS = "array<struct<start:int,kind_no:int,end:int>>"
#: Bits of the map of blobs with findings.
MARKS = 1 << 22


@dataclass(frozen=True)
class Rule:
    """A kind of secret. needs: a text without any of these (lower-case) holds none.
    group and least: the group of the pattern that must have so many characters."""

    kind: str
    version: int
    pattern: str
    needs: tuple[str, ...] = ()
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kinds in the order in which spans that start together are listed.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, ASSIGN, ("passw", "secret", "token", "api"), group=2, least=6),
    Rule("access", 1, "AKIA[A-Z0-9]+", ("akia",), least=20),
    Rule("hex", 1, "[0-9a-f]{24,}", least=24),
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key",)),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+", ("eyj",)),
    Rule("hub_token", 1, "gh[opsu]_[A-Za-z0-9]{30,}", ("gh",)),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
)
BASE_KINDS = 3

# Key header; then all up to the END line if no other mark of five dashes comes first, else
# the encryption headers, the base64 runs (line ends may be written as \\n), and a short last line.
_GAP = "(?:\\s|\\\\[nr]|[\"',>#*])"
_KEY = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    "(?:(?!-----)[\\s\\S])*+-----END [A-Z ]*PRIVATE KEY-----|"
    f"(?:\\s*(?:Proc-Type|DEK-Info):[^\\n]*)*(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}})*+"
    "(?:(?<=[A-Za-z0-9+/=])(?:\\r?\\n|\\\\n)[A-Za-z0-9+/=]+(?=\\s*(?:\\n|$)|\\\\n|[\"']))?)"
)
#: RULES with the whole private key, for redaction: RULES' own are those of op1's SQL, which
#: holds RE2 patterns without lookaround and lists the header only.
WHOLE_RULES = tuple(Rule(r.kind, 2, _KEY, r.needs) if r.kind == "private_key" else r for r in RULES)


def _spans(text: Column, rule: Column) -> Column:
    """Places of the rule's matches: each starts after the gaps and matches before it."""
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    values = F.regexp_extract_all(text, rule["pattern"], rule["group"])
    gaps = F.slice(F.split(text, rule["pattern"]), 1, F.size(hits))
    laid = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(F.length(x["value"]) < rule["least"], a["found"])
            .otherwise(F.concat(a["found"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end")))))
            .alias("found"),
        ),
    )
    return laid["found"]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs: blob, text, seen (array of rule keys), a row per blob. Returns blob and found,
    a map from the key of each rule that was not yet seen to its spans.

    A row for each blob and rule to run goes through one expression; the text is null where
    the rule's words are missing. The rows come together again where they are, by blob."""
    low = F.lower("text")
    may = [reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in r.needs]) if r.needs else F.lit(True) for r in rules]
    runs = F.array(*[
        F.struct(F.lit(r.key).alias("key"), F.lit(r.pattern).alias("pattern"), F.lit(r.group).alias("group"), F.lit(r.least).alias("least"), F.when(m, F.col("text")).alias("text"))
        for r, m in zip(rules, may, strict=True)
    ])
    seen = F.coalesce(F.col("seen"), F.array().cast("array<string>"))
    rows = blobs.select("blob", seen.alias("seen"), F.explode(runs).alias("run")).filter(~F.array_contains("seen", F.col("run.key")))
    text, run = F.col("run.text"), F.col("run")
    some = F.regexp_count(text, run["pattern"]) > 0
    spans = F.when(some, _spans(text, run)).otherwise(F.array().cast(FOUND))
    found = rows.select("blob", F.struct(run["key"].alias("key"), spans.alias("value")).alias("entry"))
    return found.groupBy("blob").agg(F.map_from_entries(F.collect_list("entry")).alias("found"))


def unseen_blobs(docs: DataFrame, text: str, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per distinct text with a rule to run: blob, text, seen. Copies meet in the
    map-side half of the aggregation, so a text that fills the table costs a row per task."""
    blobs = docs.select(F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.withColumn("seen", F.array().cast("array<string>"))
    seen = ledger.select("blob", F.explode(F.map_keys("found")).alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    return blobs.join(seen, "blob", "left").filter(F.size(F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))) > 0)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, or None before the first scan."""
    if not store.exists(spark, path):
        return None
    return spark.read.schema(f"blob string, found map<string,{FOUND}>").parquet(path)


def update_ledger(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at path lacks, append it, and return the whole ledger."""
    scan_blobs(unseen_blobs(docs, text, read_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its spans by the given rule versions, array<struct<start,kind_no,end>> in
    order of start and kind; only blobs that have some."""

    keys = F.array(*[F.lit(r.key) for r in rules])
    placed = lambda i: lambda x: F.struct(x["start"].alias("start"), i.alias("kind_no"), x["end"].alias("end"))
    found = F.transform(keys, lambda k, i: F.transform(F.coalesce(F.col("found")[k], F.array().cast(FOUND)), placed(i)))
    hits = ledger.select("blob", F.flatten(found).alias("spans")).filter(F.size("spans") > 0)
    return hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def with_findings(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column secret_spans (array<struct<start,kind_no,end>>, empty if none). spans:
    blob and spans, a row per blob with findings."""
    spans = stored(spans, "findings")
    bit = F.pmod(F.xxhash64("blob"), F.lit(MARKS))
    one = F.expr("shiftleft(1L, cast(bit % 64 AS int))")
    marks = spans.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("bits"))
    rows = docs.select(whole_row(docs).alias("row"), F.sha2(text_of(text), 256).alias("blob")).withColumn("bit", bit)
    rows = rows.join(F.broadcast(marks), F.expr("bit div 64") == F.col("word"), "left").withColumn("marked", F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False)))
    none = F.array().cast(SPANS)
    still = rows.filter("not marked").select("row", none.alias("secret_spans"))
    moved = rows.filter("marked").select("row", "blob").join(spans, "blob", "left").select("row", F.coalesce("spans", none).alias("secret_spans"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "secret_spans"]
    return still.union(moved).select(*own, "secret_spans")


def find_secrets(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secret_spans (see with_findings), by the ledger and a scan of what it lacks,
    which is not added to it."""
    scanned = scan_blobs(unseen_blobs(docs, text, ledger, rules), rules)
    book = scanned if ledger is None else ledger.unionByName(scanned)
    return with_findings(docs, spans_by_blob(book, rules), text)


def find_by_ledger(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secret_spans: scans what the ledger at path lacks, appends that, and joins
    the ledger's findings to all rows."""
    return with_findings(docs, spans_by_blob(update_ledger(docs.sparkSession, docs, path, text, rules), rules), text)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind_no"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, merged where they overlap, replaced by mark; null stays null."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).alias("out"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
