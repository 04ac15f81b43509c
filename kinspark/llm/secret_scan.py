"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Candidates are matches of fixed patterns. A hash of each candidate's value is counted over the distinct
repositories and owners that hold it: a value that many owners share is a widely copied example, while a value that
only one owner has looks like a live credential.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, prepare, unused


@dataclass(frozen=True)
class Kind:
    """pattern: Java regular expression. group: of the value. least: characters that the value needs. hints: literals of
    which every match holds one at least, searched for before the pattern is tried. noise: what is taken out of the value
    before it is hashed."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    noise: str = ""


#: White space, also escaped as in JSON.
GAP = r"(?:\s|\\+[nrt])"
#: A private key from its BEGIN line to its END line, or to the end of its base64 lines if END is missing; its headers aren't
#: part of the value. A short line ends such a run if it stands alone. Groups repeat possessively, as the others use up the stack.
PEM = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    rf"(?:{GAP}*+[A-Z][A-Za-z]*+(?:-[A-Za-z]++)++:\x20[^\r\n\\]*+(?=[\r\n\\]))*+"
    r"([^-]*+(?=-----END [A-Z ]{0,30}PRIVATE KEY-----)"
    rf"|(?:{GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{GAP}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\x20\t]*+(?:[\r\n\\\"']|\z)))?+)"
    r"(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"
)
# The base patterns.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}+", hints=("AKIA",)),
    Kind("hex", r"[0-9a-f]{24,}+"),
)
# Formats of further credentials, as their issuers document them.
MORE = (
    Kind("vendor", r"(?:gh[pousr]_|glpat-|sk_live_|xox[abprs]-)[A-Za-z0-9_-]{16,}+", hints=("_", "glpat-", "xox")),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hints=("eyJ",)),
    Kind("key", PEM, 1, hints=("PRIVATE KEY-----",), noise=rf"{GAP}++"),
)
KINDS = BASE + MORE

SPAN = "array<struct<start:bigint,end:bigint,rank:int,kind:string,hash:string>>"
#: A value that at least so many owners hold is an example.
EXAMPLE_OWNERS = 3


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Leftmost matches that do not overlap, as SPAN; positions count code points, `end` is exclusive.

    Splitting at the pattern gives the gaps between matches, so the running sums of the lengths of gaps and matches
    are the positions.
    """
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else matches
    if kind.noise:
        values = F.transform(values, lambda v: F.regexp_replace(v, kind.noise, ""))
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(
            start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"), F.sha2(part["value"], 256).alias("hash"),
        )
        good = part["match"].isNotNull() & (F.length(part["value"]) >= kind.least)
        return F.struct(F.coalesce(end, start).cast("bigint").alias("at"), F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))
    found = F.aggregate(parts, start, step, lambda s: s["spans"])
    there = text.rlike(kind.pattern)
    if kind.hints:
        there = reduce(or_, [text.contains(h) for h in kind.hints]) & there
    return F.when(there, found).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """A row per document with its spans, without its text; null repositories and owners are one of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat(*[spans_of(text, k, i) for i, k in enumerate(KINDS)]).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_rows, n_repos, n_owners: over all candidates. Counts are taken before each shuffle."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")
    )


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live, live, live_repos.

    live: the spans, as struct<start,end,kind>, whose value fewer than `example_owners` owners hold. live_repos: the most repositories that hold one of
    these values, 0 without any; a value that one owner keeps in many has to be revoked in all of them. A null text is empty
    and has no spans. Repeated rows are scanned one by one and each counts. Very long texts are scanned whole. Other
    columns are not read, so that their names cannot clash. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    scanned = candidates(docs, id_col, text_col, repo_col, owner_col).checkpoint()
    found = scanned.filter(F.size("spans") > 0).select("_row", "repo", "owner", F.explode("spans").alias("span"))
    found = found.select("_row", "repo", "owner", "span", F.col("span.hash").alias("hash"))
    # the rows of a widely copied value stay where they are
    judged = join_groups(found, ownership(found), ["hash"], "n_rows").groupBy("_row").agg(
        F.max(F.when(F.col("n_owners") < example_owners, F.col("n_repos"))).alias("live_repos"),
        F.count_if(F.col("n_owners") >= example_owners).alias("n_example"),
        F.count_if(F.col("n_owners") < example_owners).alias("n_live"),
        F.array_sort(
            F.collect_list(F.when(F.col("n_owners") < example_owners, F.struct("span.start", "span.end", "span.kind")))
        ).alias("live"),
    )
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return scanned.join(judged, "_row", "left").select(
        "doc_id", *[count(k.name) for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("live", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")).alias("live"),
        F.coalesce("live_repos", F.lit(0)).cast("long").alias("live_repos"),
    )


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner",
    example_owners: int = EXAMPLE_OWNERS, mask: str = "[SECRET]",
) -> DataFrame:
    """docs with each live span of a text replaced by `mask`; spans that overlap become one. Other columns,
    whatever their names, rows and null texts stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, id_, sha, spans = unused(docs, "_key", "_id", "_sha", "_live")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha")))
    scanned = secret_scan(keyed, key, text_col, repo_col, owner_col, example_owners)
    live = scanned.filter(F.size("live") > 0).select(F.col("doc_id.id").alias(id_), F.col("doc_id.sha").alias(sha), F.col("live").alias(spans))
    live = live.groupBy(id_, sha).agg(F.max(spans).alias(spans))

    def step(state: Column, span: Column) -> Column:
        gap = text.substr(state["at"].cast("int") + 1, F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        new = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(new, F.concat(state["out"], F.array(gap, F.lit(mask)))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), text.substr(s["at"].cast("int") + 1, F.length(text)))
    masked = F.aggregate(spans, start, step, rest)
    joined_ = keyed.join(live, keyed[f"{key}.id"].eqNullSafe(live[id_]) & (keyed[f"{key}.sha"] == live[sha]), "left")
    return joined_.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(masked)).drop(key, id_, sha, spans)
