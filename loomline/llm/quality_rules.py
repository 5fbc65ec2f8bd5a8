"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per text. The ledger holds the measurements and one bit per
failed rule; a policy is a versioned mask over those bits, so another policy or an ablation
reads the ledger and never the texts again.

Defined results: a null text counts as empty; an empty text has no words and fails
``few_words``; repeated rows are measured each on its own; the input's other columns are
ignored unless asked for by ``keep``. Two 8-word windows count as equal when the 64-bit hashes
of their word hashes are. Texts of any length are measured whole, in one row's memory; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import text_of, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"

#: Rules in bit order: name, then the condition on the measurements under which a text fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("stuttering", "100 * n_stutters > 20 * n_words"),
    ("exclaiming", "100 * n_exclaims > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_exclaims", "n_stutters",
)


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a text, under a version that is never reused."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy(1, ("few_words", "repeated_windows"))
#: Repeated lines are recorded only: clean lists and verse repeat lines too.
STANDARD = Policy(2, (*BASE.rules, "symbols", "shouting", "stuttering", "exclaiming"))


def _absent(text: Column, pattern: str) -> Column:
    """How many characters of text the pattern's matches take."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the MEASURES and fail_bits of every row of docs; one scan, no shuffle. Columns of
    keep that are named like one of those give way to it."""
    asked, keep = keep, ("keep_",)
    base = docs.select(F.struct(*[F.col(c) for c in asked]).alias("keep_"), text_of(text).alias("t_"))
    base = base.select(*keep, "t_", words_of(F.col("t_")).alias("w_"))
    lines = F.filter(F.split("t_", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = base.select(
        *keep,
        F.size("w_").cast("long").alias("n_words"),
        F.length(F.array_join("w_", "")).cast("long").alias("word_chars"),
        _absent(F.col("t_"), SYMBOLS).alias("n_symbols"),
        _absent(F.col("t_"), "[A-Z]+").alias("n_upper"),
        _absent(F.col("t_"), "!+").alias("n_exclaims"),
        lines.alias("l_"),
        F.transform("w_", lambda w: F.xxhash64(w)).alias("h_"),
    )
    hashes = F.col("h_")
    window = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("h_") - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        ),
    )
    base = base.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_exclaims",
        F.size("l_").cast("long").alias("n_lines"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("h_", lambda x, i: x == F.get(hashes, i + 1))).cast("long").alias("n_stutters"),
        window.alias("v_"),
    )
    rest = [c for c in base.columns if c != "v_"]
    # only texts with some repeated window go on: hash and place, sorted, bring equal windows together
    twice = F.size(F.array_distinct("v_")) < F.size("v_")
    base = base.select(*rest, F.when(twice, F.array_sort(F.transform("v_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s_"))
    s = F.col("s_")
    starts = F.filter(
        F.transform(s, lambda x, k: F.when((x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h), x.i)),
        lambda i: i.isNotNull(),
    )
    base = base.select(*rest, F.array_sort(starts).alias("p_"))
    p = F.col("p_")
    covered = F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    base = base.select(*rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    made = {"fail_bits", *MEASURES}
    own = [F.col("keep_")[c].alias(c) for c in asked if c.lower() not in made]
    return base.select(*own, *MEASURES, bits.alias("fail_bits"))


def rejected(policy: Policy) -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with policy_version and kept."""
    return book.withColumns({"policy_version": F.lit(policy.version), "kept": ~rejected(policy)})


def kept_rows(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger's rows that the policy keeps. The verdict passes through a generator, so
    that the optimizer doesn't copy all measuring into the filter."""
    marked = book.select("*", F.explode(F.array(~rejected(policy))).alias("kept_"))
    return marked.filter("kept_").drop("kept_")


def ablations(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """One row per rule of the policy: texts that fail it, texts that only it rejects, and
    texts kept without it. One aggregation over the bits, with a row per task to shuffle."""
    mask = F.lit(policy.mask).cast("long")
    hit = F.col("fail_bits").bitwiseAND(mask)
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(hit == 0).alias("kept")]
    for name in policy.rules:
        bit = F.lit(BITS[name]).cast("long")
        sums += [F.count_if(hit.bitwiseAND(bit) != 0).alias(f"f_{name}"), F.count_if(hit == bit).alias(f"o_{name}")]
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("n_failed"), F.col(f"o_{name}").alias("n_only"), (F.col("kept") + F.col(f"o_{name}")).alias("n_kept_without"))
        for name in policy.rules
    ]
    return book.agg(*sums).select(F.inline(F.array(*rows)))
