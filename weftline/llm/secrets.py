"""Secret scan over an incremental blob ledger, with DataFrame operations only.

Every version of a document is content-addressed (SHA-256 of its UTF-8). The
ledger holds one row per scanned (blob, rule, rule version) and the findings
table the spans per blob. A scan reads only pairs that the ledger lacks, and
findings are joined back to all paths that carry the blob, so copies and
unchanged history cost one hash each.

A rule is a Java regular expression whose first group is the whole finding.
Findings are the leftmost matches that don't overlap within their rule. Where
``min_len`` is set, matches whose second group is shorter are dropped after
matching. Offsets are code points, the end exclusive.

Defined cases: null text is the empty text; repeated rows and copies each get
their own result row; ties at one start are ordered as the rules are listed;
empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import materialize


@dataclass(frozen=True)
class Rule:
    """``hint``: a literal-led pattern that every match contains, for a first look."""

    kind: str
    version: int
    pattern: str
    min_len: int
    hint: str
    base: bool = True


RULES = (
    Rule(
        "assign", 1,
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        12, r"""(?:[dDtTnNyY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    ),
    # A longest run holds at most one match, so the length can be asked for in
    # the pattern: a run that is too short drops out either way.
    Rule("access", 1, "(AKIA[A-Z0-9]{14,})", 0, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "((?<![0-9a-f])[0-9a-f]{16,})", 0, "[0-9a-f]{16}"),
    Rule("pem", 1, "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0, "-----BEGIN ", base=False),
    Rule("forge", 1, "(gh[pousr]_[A-Za-z0-9]{36,})", 0, "gh[pousr]_[A-Za-z0-9]{36}", base=False),
)

PAIR = "blob_id string, kind string, rule_version int"
FOUND = "blob_id string, kind string, rule_version int, start long, end long"


def versions(docs: DataFrame) -> DataFrame:
    """Each row with the content address of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob_id"))


def scan(
    spark: SparkSession,
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Findings of the unseen (blob, rule version) pairs, and those pairs.

    Append both to the stored findings and ledger; a second scan of the same
    history then has nothing to do.
    """
    todo = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is not None:
        current = None
        for r in rules:
            c = (F.col("kind") == r.kind) & (F.col("rule_version") == r.version)
            current = c if current is None else current | c
        # At most one entry for each rule. Texts don't move for the look-up.
        seen = ledger.where(current).groupBy("blob_id").agg(F.collect_set("kind").alias("seen"))
        ids = versions(docs).select("blob_id").distinct().join(seen, "blob_id", "left")
        left = F.array_except(todo, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
        ids = materialize(spark, ids.select("blob_id", left.alias("todo")).where(F.size("todo") > 0), "secrets-todo")
        blobs = versions(docs).groupBy("blob_id").agg(F.first("text").alias("text")).join(ids, "blob_id")
    else:
        ids = versions(docs).select("blob_id").distinct().select("blob_id", todo.alias("todo"))
        blobs = versions(docs).groupBy("blob_id").agg(F.first("text").alias("text")).select("blob_id", "text", todo.alias("todo"))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    pairs = ids.select("blob_id", F.explode("todo").alias("kind")).select("blob_id", "kind", version[F.col("kind")].alias("rule_version"))
    return _spans(blobs, rules), pairs


def _spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Matches with their places.

    Each match comes with the text before it, back to the match before, so a
    running sum of lengths gives every offset. Matches are rows, so a text with
    any number of them needs no array of that size twice.
    """
    empty = F.array().cast("array<struct<kind:string,before:int,len:int,part:int>>")
    found = []
    for r in rules:
        # \\G: each match starts where the one before ended, or there is none.
        lead = F.lit(rf"\G(?s)(.*?){r.pattern}")
        n = [F.transform(F.regexp_extract_all("text", lead, F.lit(g)), lambda x: F.length(x)) for g in (1, 2, *([3] * bool(r.min_len)))]
        kind = F.lit(r.kind).alias("kind")
        rows = F.transform(
            F.arrays_zip(n[0].alias("before"), n[1].alias("len"), n[-1].alias("part")),
            lambda z: F.struct(kind, z["before"].alias("before"), z["len"].alias("len"), z["part"].alias("part")),
        )
        wanted = F.array_contains("todo", r.kind) & F.col("text").rlike(r.hint)
        found.append(F.when(wanted, rows).otherwise(empty))
    some = F.col("text").rlike("|".join(r.hint for r in rules))
    at = blobs.where(some).select("blob_id", F.posexplode(F.concat(*found)).alias("n", "m")).select("blob_id", "n", "m.*")
    end = F.expr("sum(before + len) OVER (PARTITION BY blob_id, kind ORDER BY n ROWS UNBOUNDED PRECEDING)")
    at = at.withColumn("end", end.cast("long"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.min_len))])
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    return at.where(F.col("part") >= least[F.col("kind")]).select(
        "blob_id",
        "kind",
        version[F.col("kind")].alias("rule_version"),
        (F.col("end") - F.col("len")).alias("start"),
        "end",
    )


def scan_versions(spark: SparkSession, docs: DataFrame, releases: tuple[tuple[Rule, ...], ...]) -> tuple[DataFrame, DataFrame]:
    """Findings and ledger after a scan with each release of the rules in turn.

    Findings and ledger are stored after each scan; the next reads the ledger and
    scans only the (blob, rule version) pairs that it lacks.
    """
    found = ledger = None
    for rules in releases:
        new, pairs = scan(spark, docs, ledger, rules)
        new, pairs = materialize(spark, new, "secrets-found"), materialize(spark, pairs, "secrets-ledger")
        found = new if found is None else found.unionByName(new)
        ledger = pairs if ledger is None else ledger.unionByName(pairs)
    return found, ledger


def findings_by_path(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to every row that carries the blob."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    base = F.array(*[F.lit(r.kind) for r in rules if r.base])
    # As many entries as one text has findings.
    per_blob = findings.groupBy("blob_id").agg(
        F.array_sort(F.collect_set(F.struct("start", order[F.col("kind")].alias("o"), "end", "kind"))).alias("f")
    )
    show = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("f", lambda x: x["kind"] == kind)).cast("long")
    cols = [count(r.kind).alias(f"n_{r.kind}") for r in rules if r.base]
    shown = per_blob.select("blob_id", *cols, show(F.filter("f", lambda x: F.array_contains(base, x["kind"]))).alias("base"), show(F.col("f")).alias("spans"))
    # A table of its own, so that Spark can split the join where very many paths
    # carry one blob.
    shown = materialize(docs.sparkSession, shown, "secrets-shown").hint("merge")
    paths = versions(docs).select("doc_id", "blob_id")
    none = F.lit("")
    return paths.join(shown, "blob_id", "left").select(
        "doc_id",
        "blob_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(F.coalesce("base", none), 256).alias("base_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )
