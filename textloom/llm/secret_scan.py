"""Secret scan: candidate spans, judged by who else owns the same value. DataFrame operators only.

Every candidate's value is hashed and counted over the corpus by distinct
repositories and owners. A value that few owners hold looks live; one that many
hold is a copied example. Candidates of the added kinds count as secrets only if
they look live; candidates of the base kinds always do, and are counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

# The kinds in the order of a tie, pattern, group with the value, least length of that group.
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]+)", 1, 16),
]
BASE = ("assign", "access", "hex")
#: A run of hex digits fails alone if it is short, so only long ones need a look.
SEARCH = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}
#: A value that at most so many owners and repositories hold looks live.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 4


def _matches(text: Column, number: int) -> Column:
    """Array of (kind, place among the kind's matches, length before it, own length, value); failing matches too."""
    name, pattern, group, _ = KINDS[number]
    search = F.lit(SEARCH.get(name, pattern))
    found = F.arrays_zip(
        F.transform(F.split(text, SEARCH.get(name, pattern), -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, search, F.lit(0)), F.length).alias("len"),
        F.regexp_extract_all(text, search, F.lit(group)).alias("value"),
    )
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["len"].alias("len"), m["value"].alias("value")
        ),
    )
    return F.when(text.rlike(SEARCH.get(name, pattern)), F.filter(rows, lambda m: m["value"].isNotNull()))


def _joined(flag: Column, name: str) -> Column:
    parts = F.when(flag, F.struct("start", "kind", F.concat_ws(":", "name", "start", "end").alias("s")))
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["s"])).alias(name)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None
) -> DataFrame:
    """One row per input row: ``(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example)``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and
    then by kind. Null text counts as empty and has no spans; a null owner or
    repository is one more owner or repository. Rows with the same id are scanned
    apart. An empty table gives no rows; columns that are not named are not read.
    """
    owner = F.lit("") if owner is None else owner
    repository = owner if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:string>>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("\0")).alias("repository"),
        F.concat(*[F.coalesce(_matches(text, n), none) for n in range(len(KINDS))]).alias("found"),
    )
    rows = kept(rows, "secret-candidates")

    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    upto = Window.partitionBy("row", "kind").orderBy("i")
    spans = (
        rows.filter(F.size("found") > 0)
        .select("row", "owner", "repository", F.inline("found"))
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
        .filter(F.length("value") >= least)
        .select("row", "owner", "repository", "kind", (F.col("end") - F.col("len")).alias("start"), "end", F.sha2("value", 256).alias("hash"))
    )
    spans = kept(spans, "secret-spans")

    owned = spans.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = owned.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    judged = held.select("hash", live.alias("live"))

    base = F.col("kind") < len(BASE)
    per_row = (
        spans.join(judged, "hash")
        .withColumn("name", F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1))
        .groupBy("row")
        .agg(
            *[F.count_if(F.col("kind") == n).alias(f"n_{name}") for n, name in enumerate(BASE)],
            _joined(base, "base"),
            _joined(base | F.col("live"), "spans"),
            F.count_if("live").alias("n_live"),
            F.count_if(~F.col("live")).alias("n_example"),
        )
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return rows.select("row", "id").join(per_row, "row", "left").select(
        F.col("id").alias(id_col),
        *[zero(f"n_{name}") for name in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        zero("n_live"),
        zero("n_example"),
    )
