"""Secrets in texts, and how widely each one is copied.

Patterns give candidate spans. All candidates of the corpus are then counted by value: in how many
repositories and by how many owners it occurs. A value that several owners have, or one owner has in
many repositories, is a copied example; one that stays with its owner and looks random is a live
credential, and is reported even where nothing around it says so. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.session import materialise

# The kinds in order (fixed patterns): name, pattern, group with the value, fewest characters of it.
# Shorter runs of the last three never end in a longer match, so their minimum is in the pattern.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    # With the mark of ``masked``, so that a run which meets a base match can be told.
    ("generic", "[A-Za-z0-9+/_=\uffff-]{20,}", 0, 20),
)
GENERIC = len(KINDS) - 1
# A value with at least so many owners, or in at least so many repositories, is a copied example.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 50
# Values in more repositories than this are spread over ``SALTS`` parts when counts go back to them.
HOT_REPOSITORIES, SALTS = 4096, 64
# Matches whose positions are added up together; their sums are added up per such block after that.
BLOCK = 128
# Stands in for a character of a base match where generic ones are searched; no text means anything by it.
MASK = "\uffff"
SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def _parts(text: Column, kind: int) -> Column:
    """Array of (gap, match, value): every match of a kind with what lies before it, and the last gap."""
    _, pattern, group, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))


def _lengths(part: Column) -> tuple[Column, Column]:
    """Code points before a part's match, and of the match; the last part has none."""
    return F.length(part["gap"]).cast("long"), F.coalesce(F.length(part["match"]), F.lit(0)).cast("long")


def _running(items: Column, empty: Column, add: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold ``items`` into (at, out): ``add`` gives the step of ``at`` and an item of ``out`` from (at, item)."""

    def step(state: Column, item: Column) -> Column:
        far, made = add(state["at"], item)
        return F.struct((state["at"] + far).alias("at"), F.concat(state["out"], F.array(made)).alias("out"))

    return F.aggregate(items, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)


def matches(text: Column, kind: int) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches of one kind.

    What lies between the matches, and the matches themselves, are added up to positions in code
    points, end excluded: inside blocks of ``BLOCK`` matches first, then over the blocks, as a fold
    that appends copies what it has at every step.
    """
    _, pattern, _, least = KINDS[kind]
    none = F.array().cast(SPANS)

    def place(at: Column, part: Column) -> tuple[Column, Column]:
        gap, match = _lengths(part)
        start = at + gap
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + match).alias("end"), part["value"].alias("value"))
        # The last gap has no match and ends the text.
        keeps = part["match"].isNotNull() & (F.length(part["value"]) >= least)
        return gap + match, F.when(keeps, span)

    def moved(block: Column, by: Column) -> Column:
        shift = lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        return F.transform(F.filter(block["out"], lambda s: s.isNotNull()), shift)

    def spans(parts: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(parts), F.lit(BLOCK))
        return _let(F.transform(firsts, lambda i: _running(F.slice(parts, i, F.lit(BLOCK)), none, place)), in_place)

    def in_place(blocks: Column) -> Column:
        offsets = _running(blocks, F.array().cast("array<long>"), lambda at, block: (block["at"], at))["out"]
        return F.flatten(F.zip_with(blocks, offsets, moved))

    return F.when(text.rlike(pattern), _let(_parts(text, kind), spans)).otherwise(none)


def masked(text: Column) -> Column:
    """The text with a mark in place of every character of a base match.

    A kind that is masked later may lose a part of its match to an earlier one; what is left of it
    touches a mark then, so a run of generic characters that meets a base match has a mark in it.
    """
    out = F.translate(text, MASK, " ")
    for kind in range(GENERIC):
        out = _let(out, _hider(kind))
    return out


def _hider(kind: int) -> Callable[[Column], Column]:
    """A function of texts: the text with the matches of one kind masked."""
    _, pattern, _, least = KINDS[kind]

    def hide(part: Column) -> Column:
        match = F.coalesce(part["match"], F.lit(""))
        marks = F.repeat(F.lit(MASK), F.length(match))
        return F.concat(part["gap"], F.when(F.length(part["value"]) >= F.lit(least), marks).otherwise(match))

    return lambda text: F.when(text.rlike(pattern), F.array_join(F.transform(_parts(text, kind), hide), "")).otherwise(text)


def looks_live(value: Column) -> Column:
    """Random-looking: digits, small and capital letters together."""
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """(row, id, repository, owner, base, more): base spans, and generic ones that meet none of them.

    Time is linear in the text and its matches: generic runs are searched in the masked text, so
    they are not held against base spans one by one.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    base = F.array_sort(F.concat(*(matches(F.col("text"), kind) for kind in range(GENERIC))))
    generic = _let(masked(F.col("text")), lambda text: matches(text, GENERIC))
    more = F.filter(generic, lambda g: ~F.contains(g["value"], F.lit(MASK)) & looks_live(g["value"]))
    # Most texts have no run that is long enough, masked or not.
    more = F.when(F.col("text").rlike(KINDS[GENERIC][1].replace(MASK, "")), more).otherwise(F.array().cast(SPANS))
    return rows.select("row", "id", "repository", "owner", base.alias("base"), more.alias("more"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners) from (value_hash, repository, owner).

    A repository belongs to its owner: equal names of two owners are two. NULL repositories and
    owners count as one each. Repeats shrink in three partial steps before
    each exchange, so that a value which every repository has is never gathered in one task.
    """
    same = F.coalesce(F.col("owner"), F.lit("")).alias("owner"), F.coalesce(F.col("repository"), F.lit("")).alias("repository")
    each = candidates.select("value_hash", *same).distinct()
    per_owner = each.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("in_owner"))
    return per_owner.groupBy("value_hash").agg(F.sum("in_owner").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def with_ownership(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (with row and value_hash) with their counts; hot values are salted."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    hot = counts.where(F.col("repositories") > HOT_REPOSITORIES)
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cool = counts.where(F.col("repositories") <= HOT_REPOSITORIES)
    tried = candidates.withColumn("salt", salt).join(hot, ["value_hash", "salt"], "left").drop("salt")
    spread = tried.where("repositories is not null")
    rest = tried.where("repositories is null").drop("repositories", "owners").join(cool, "value_hash")
    return spread.unionByName(rest)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
    copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """(row, id, base, spans, n_live, n_copied) per row of ``docs``.

    ``base`` has the spans of the patterns with a meaning of their own, whatever their counts say.
    ``spans`` adds the generic ones that are owner-specific: random-looking, with fewer than
    ``copied_owners`` owners, and in fewer than ``copied_repositories`` repositories, as a value that
    one owner has pasted everywhere is an example too. Both are arrays of (kind, start, end) by start, then kind; kind is a
    number in ``KINDS``. ``n_live`` and ``n_copied`` count the spans on either side of that line.
    NULL text is empty and has no spans; an empty table gives an empty result.
    """
    found = materialise(candidate_spans(docs, id_col, text_col, repository_col, owner_col), "secret-candidates")
    one = found.select("row", "repository", "owner", F.explode(F.concat("base", "more")).alias("span"))
    one = one.select("row", "repository", "owner", F.sha2("span.value", 256).alias("value_hash"), "span.kind", "span.start", "span.end")
    counts = materialise(ownership(one), "secret-owners")
    judged = with_ownership(one.drop("repository", "owner"), counts).withColumn(
        "copied", (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    )
    told = F.when(~F.col("copied") | (F.col("kind") < GENERIC), F.struct("start", "kind", "end"))
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(told)).alias("told"),
        F.count_if(~F.col("copied")).alias("n_live"),
        F.count_if("copied").alias("n_copied"),
    )
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    zero = F.lit(0).cast("long")
    return found.join(per_row, "row", "left").select(
        "row",
        "id",
        plain(F.col("base")).alias("base"),
        F.coalesce(plain(F.col("told")), plain(F.col("base"))).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_copied", zero).alias("n_copied"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(name) for name, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def number_of(spans: Column, kind: int) -> Column:
    """How many of the spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
