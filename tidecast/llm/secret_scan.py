"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

1. One pass over the texts finds candidates of four kinds and writes them
   as spans with the SHA-256 of the secret value: ``assign`` (a keyword, a
   separator and a value), ``access`` (access key ids), ``hex`` (long hex
   runs), and ``owned`` candidates (any other long token with a digit).
2. The candidate hashes are aggregated over the whole corpus: in how many
   distinct repositories and with how many distinct owners does a value
   occur? Distinct (value, owner, repository) first, then counts, each
   with map-side combine, so a value copied everywhere stays cheap.
3. A value that more than ``max_owners`` owners or more than ``max_repos``
   repositories carry is a copied example; any other looks live. A bare token becomes an added
   ``owned`` span when it is not copied and it either repeats a value
   that some document holds as a base secret, or mixes upper case, lower
   case and digits as generated credentials do. Base spans always stay.

Positions come from splitting the text at the pattern: the i-th match
starts after i + 1 pieces and i matches, counted in code points. The sums
are running sums over the matches of a text, and a bare token's overlap with
base spans is decided by the nearest spans on either side, so the work grows
with the number of matches and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import stage

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A run of 20 or more token characters, one of them a digit.
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
LEAST_VALUE = 6



def matches(text: Column, pattern: str, k: int, group: int = 0, least: int = 0) -> Column:
    """array<struct(k, i, gap, len, h, mixed, fits)> of the leftmost
    non-overlapping matches: code points before it since the last match, its
    own, the SHA-256 of the group's text, whether that mixes upper case, lower
    case and digits, and whether it has ``least`` code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(before.alias("p"), found.alias("m"), value.alias("v"))
    each = F.transform(zipped, lambda x, i: F.struct(
        F.lit(k).alias("k"), i.alias("i"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("len"),
        F.unhex(F.sha2(x["v"], 256)).alias("h"),
        (x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]") & x["v"].rlike("[0-9]")).alias("mixed"),
        (F.char_length(x["v"]) >= least).alias("fits")))
    none = F.expr("cast(array() as array<struct<k:int,i:int,gap:int,len:int,h:binary,mixed:boolean,fits:boolean>>)")
    return F.when(text.rlike(pattern), each).otherwise(none)


def candidates(docs: DataFrame, owner: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: (rid, doc_id) of every row of ``docs``, and the
    candidate spans (rid, owner, repo, start, k, end, h, mixed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(matches(text, ASSIGN, 0, 2, LEAST_VALUE), matches(text, ACCESS, 1), matches(text, HEX, 2),
                     matches(text, BARE, 3))
    rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"),
                             F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repo"),
                             every.alias("found")), "secrets")
    each = rows.where(F.size("found") > 0).select("rid", "owner", "repo", F.inline("found"))
    # all windows are over the matches of one text
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(Window.partitionBy("rid", "k").orderBy("i"))
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("fits")
    left = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy("rid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("reach", F.max(F.when(F.col("k") < 3, F.col("end"))).over(left)) \
        .withColumn("next", F.min(F.when(F.col("k") < 3, F.col("start"))).over(right))
    # a bare token that overlaps a base span adds nothing
    touched = (F.coalesce(F.col("reach") > F.col("start"), F.lit(False))
               | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    kept = spans.where((F.col("k") < 3) | ~touched).select(
        "rid", "owner", "repo", F.col("start").cast("int").alias("start"), "k", F.col("end").cast("int").alias("end"), "h", "mixed")
    return rows.select("rid", "doc_id"), stage(kept, "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos, in_base) over exploded candidate spans."""
    once = spans.groupBy("h", "owner", "repo").agg(F.max(F.col("k") < 3).alias("in_base"))
    by_owner = once.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.max("in_base").alias("in_base"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"),
                                     F.max("in_base").alias("in_base"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
                max_owners: int = 2, max_repos: int = 10, with_evidence: bool = False) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text, the owner and the
    repository column): doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_example, and ``with_evidence`` the string evidence
    (kind:start:end:owners:repositories of the same spans).

    ``spans`` lists kind:start:end of base and added spans by start, then
    kind as in ``KINDS``. n_live and n_example count the base spans whose
    value looks live, or is copied: more than ``max_owners`` owners or more
    than ``max_repos`` repositories carry it.

    Defined cases: a null text counts as empty (no spans, the SHA-256 of
    the empty string); a null owner is one owner of its own, and so is a
    null repository; rows repeated with the same id each get a row of their
    own, and count as one repository; an empty table gives an empty
    result; extra columns are ignored whatever their names.
    """
    rows, each = candidates(docs, owner, repository)
    known = ownership(each)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    stays = (F.col("k") < 3) | (live & (F.col("in_base") | F.col("mixed")))
    judged = each.join(known, "h").select("rid", F.struct(
        "start", "k", "end", live.alias("live"), stays.alias("stays"), "n_owners", "n_repos").alias("s"))
    by_row = judged.where("s.stays").groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("all"))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,live:boolean,stays:boolean,"
                  "n_owners:bigint,n_repos:bigint>>)")
    out = rows.join(by_row, "rid", "left").withColumn("all", F.coalesce("all", none))
    base = F.filter("all", lambda s: s["k"] < 3)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column, *more: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["k"] + 1), *[s[c].cast("string") for c in ("start", "end", *more)])), ",")

    def count(cond) -> Column:
        return F.size(F.filter("all", cond)).cast("long")

    def of_kind(k: int):
        return lambda s: s["k"] == k

    return out.select(
        "doc_id", *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
        count(lambda s: (s["k"] < 3) & s["live"]).alias("n_live"),
        count(lambda s: (s["k"] < 3) & ~s["live"]).alias("n_example"),
        *([joined(F.col("all"), "n_owners", "n_repos").alias("evidence")] if with_evidence else []))
