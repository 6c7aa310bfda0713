"""Secret scans: spans found by patterns, told apart by how many owners share a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.llm.arrays import scanned
from rowworth.session import settle

# The base patterns.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
# Further forms: private key blocks, prefixed and signed tokens, long opaque runs.
OPAQUE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----|\bgh[pousr]_[A-Za-z0-9]{36,}"
    r"|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*|[A-Za-z0-9+/]{32,}={0,2}"
)
KINDS = ("assign", "access", "hex", "opaque")
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _mixed(value: Column) -> Column:
    return value.rlike("^(-----|gh[pousr]_|eyJ)") | (value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]"))


def _spans(text: Column, rank: int, pattern: str, value, holds) -> Column:
    """Spans of all matches that pass `holds`, leftmost first, in code points.

    Matches and the pieces between them come from the same matcher, so running lengths give the
    places. The pieces are only cut for texts that have a match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("match")))
    nothing = F.array().cast(f"array<{_SPAN}>")

    def step(at, s):
        start = at + s["gap"]
        end = start + F.coalesce(F.char_length(s["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(KINDS[rank]).alias("kind"), value(s["match"]).alias("value")
        )
        return end, F.when(holds(s["match"]), F.array(span)).otherwise(nothing)

    return F.when(F.size(matches) > 0, scanned(steps, F.lit(0), step, _SPAN)).otherwise(nothing)


def _outside_base(spans: Column, element: str) -> Column:
    """The spans, sorted, without the opaque ones that are copied or meet a base span.

    A base span that meets one either stands before it and ends behind its start, or is the next
    base span and starts before its end: two passes see both.
    """
    nothing = F.array().cast(f"array<{element}>")

    def forward(reach, s):
        base = s["rank"] < 3
        keep = base | (s["live"] & (reach <= s["start"]))
        return F.when(base, F.greatest(reach, s["end"])).otherwise(reach), F.when(keep, F.array(s)).otherwise(nothing)

    def backward(next_, s):
        base = s["rank"] < 3
        keep = base | next_.isNull() | (next_ >= s["end"])
        return F.when(base, s["start"]).otherwise(next_), F.when(keep, F.array(s)).otherwise(nothing)

    before = scanned(spans, F.lit(0), forward, element)
    return F.reverse(scanned(F.reverse(before), F.lit(None).cast("int"), backward, element))


def span_array(text: Column) -> Column:
    """All candidate spans of a text (null: empty), by start, then kind as in KINDS."""
    text = F.coalesce(text, F.lit(""))

    def assigned(m):
        return F.regexp_replace(m, "^" + ASSIGN_HEAD, "")

    def same(m):
        return m

    found = [
        _spans(text, 0, ASSIGN, assigned, lambda m: m.isNotNull() & (F.char_length(assigned(m)) >= 12)),
        _spans(text, 1, ACCESS, same, lambda m: m.isNotNull() & (F.char_length(m) >= 18)),
        _spans(text, 2, HEX, same, lambda m: m.isNotNull()),
        _spans(text, 3, OPAQUE, same, lambda m: m.isNotNull() & _mixed(m)),
    ]
    return F.array_sort(F.concat(*found))


def find_secrets(
    docs: DataFrame,
    owner: str | Column = "source",
    repository: str | Column | None = None,
    live_owners: int = 1,
    live_repositories: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: doc_id, spans, and the columns of `carry`.

    `spans` is an array of (start, rank, end, kind, owners, repositories, live), by start and kind.
    The hash of each candidate value is aggregated over the whole corpus: a value that more than
    `live_owners` owners or `live_repositories` repositories hold is a copied example; others are
    live-looking. The base kinds (assign, access, hex) are always kept and marked; opaque runs
    are only kept where they are live-looking and inside no base span.

    Values are counted by distinct (hash, owner, repository) first, so a value in a third of all
    rows is a few partial rows a task, and its join back can be split. Null texts count as empty,
    null owners and repositories as none. Repeated rows get equal results. An empty table gives
    no row.
    """
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = F.col(repository) if isinstance(repository, str) else repository
    if repository is None:
        repository = owner
    rows = settle(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", *carry, owner.cast("string").alias("_owner"),
            repository.cast("string").alias("_repository"),
            F.transform(
                span_array(F.col("text")),
                lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
                                   F.sha2(s["value"], 256).alias("hash")),
            ).alias("_spans"),
        )
    )
    each = rows.where(F.size("_spans") > 0).select("_row", "_owner", "_repository", F.explode("_spans").alias("s"))
    each = each.select("_row", "_owner", "_repository", "s", F.col("s.hash").alias("hash"))
    held = each.groupBy("hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("times"))
    known = held.groupBy("hash").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repository").alias("repositories"))
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    marked = each.join(known, "hash").select(
        "_row",
        F.struct(
            F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
            "owners", "repositories", live.alias("live"),
        ).alias("s"),
    )
    spans = marked.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    element = spans.schema["spans"].dataType.elementType.simpleString()
    spans = spans.withColumn("spans", F.when(F.exists("spans", lambda s: s["rank"] == 3), _outside_base(F.col("spans"), element)).otherwise(F.col("spans")))
    nothing = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, "_row", "left").select("doc_id", *carry, F.coalesce("spans", nothing).alias("spans"))


def redact(text: Column, spans: Column, live_mark: str = "[secret]", copied_mark: str = "[example]") -> Column:
    """The text with every span (sorted by start) replaced; spans that meet are replaced as one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        mark = F.when(s["live"], live_mark).otherwise(copied_mark)
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, zero, step)
    rest = F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
