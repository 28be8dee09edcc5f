"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import staged, tasks_for, unused

#: The base kinds, in order, as (kind, pattern, group of the secret, least length of that group).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further candidates: long strings that mix digits, capitals and small letters.  They become spans only if
#: the corpus shows them to be one owner's.
MIXED = ("mixed", r"[A-Za-z0-9_+/-]{24,}", 0, 24)
#: A value that more owners than this share is a copied example.
MOST_OWNERS = 1
MOST_REPOSITORIES = 3

SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,value:string,byte:int,byte_stop:int>>"
#: Entries of an array that are added up one after the other; longer ones are put together from such blocks.
_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """``merge`` of all entries up to each one.

    Arrays can only be extended by copying them, so this is done in blocks, and along the blocks: the work is
    a few hundred steps an entry, not one for every other entry.
    """
    extended = lambda a, x: F.concat(a, F.array(merge(F.element_at(a, -1), x)))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))

    def along(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, lambda p: F.aggregate(p, zero, merge)), F.array(zero), extended)
        inside = lambda start: F.flatten(
            F.transform(parts, lambda p, i: F.slice(F.aggregate(p, F.array(F.get(start, i)), extended), F.lit(2), F.size(p)))
        )
        return let(before, inside)

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), along)).otherwise(F.slice(F.array(zero), 1, 0)))


def matches(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of one kind, leftmost and not overlapping, in code points and in bytes.

    What stands between matches (``split``) and the matches themselves give every end as a running sum of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("whole"), value.alias("value"), F.slice(between, 1, F.size(found)).alias("gap"))
    sizes = lambda x: F.struct(
        (F.length(x["gap"]) + F.length(x["whole"])).alias("c"), (F.octet_length(x["gap"]) + F.octet_length(x["whole"])).alias("b")
    )
    plus = lambda a, x: F.struct((a["c"] + x["c"]).alias("c"), (a["b"] + x["b"]).alias("b"))
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"))

    def span(x: Column, end: Column) -> Column:
        return F.struct(
            (end["c"] - F.length(x["whole"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end["c"].alias("stop"),
            x["value"].alias("value"), (end["b"] - F.octet_length(x["whole"])).alias("byte"), end["b"].alias("byte_stop"),
        )

    spans = let(rows, lambda r: let(running(F.transform(r, sizes), plus, zero), lambda ends: F.transform(r, lambda x, i: span(x, F.get(ends, i)))))
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least).cast(SPAN)
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPAN))


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` (in order, not overlapping) that touch none of ``base``.

    Both are put in one order, starts of ``base`` and ends of ``more``; a span is apart if no base span that starts before its end
    reaches beyond its start.
    """
    starts = F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("later"), s["stop"].alias("reach"), F.lit(-1).alias("number")))
    ends = F.transform(more, lambda s, i: F.struct(s["stop"].alias("at"), F.lit(0).alias("later"), F.lit(-1).alias("reach"), i.alias("number")))

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), lambda a, x: F.greatest(a, x), F.lit(-1))
        number = lambda r: F.transform(
            events, lambda e, i: F.when((e["number"] >= 0) & (F.get(r, i) <= F.get(more, e["number"])["start"]), e["number"])
        )
        return let(reach, lambda r: F.array_sort(F.filter(number(r), lambda n: n.isNotNull())))

    return F.transform(let(F.array_sort(F.concat(starts, ends)), free), lambda n: F.get(more, n))


def candidates(docs: DataFrame, *, text_col: str, id_col: str, owner: Column, repository: Column) -> DataFrame:
    """Base spans and further candidates per document; the text itself is left behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*(matches(text, *kind, rank) for rank, kind in enumerate(BASE))))
    kind, pattern, group, least = MIXED
    more = F.filter(
        matches(text, kind, pattern, group, least, len(BASE)),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"),
    )
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        owner.alias("owner"), repository.alias("repository"), base.alias("base"), more.alias("more"),
    )
    return found.withColumn("more", F.when((F.size("base") > 0) & (F.size("more") > 0), apart(F.col("more"), F.col("base"))).otherwise(F.col("more")))


def ownership(found: DataFrame, tasks: int) -> DataFrame:
    """Candidate hashes by distinct owners and repositories: ``secret``, ``owners``, ``repositories``, ``copies``.

    Counted in two steps, first per (hash, owner, repository), so that a secret copied into very many documents
    is combined before it is shuffled by its hash alone.
    """
    each = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select(
        F.sha2("s.value", 256).alias("secret"), "owner", "repository"
    )
    counted = each.groupBy("secret", "owner", "repository").agg(F.count(F.lit(1)).alias("n")).coalesce(tasks)
    by_owner = counted.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")).coalesce(tasks)
    return by_owner.groupBy("secret").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("copies")
    )


def scan_secrets(
    docs: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    owner: Column | None = None,
    repository: Column | None = None,
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """All documents with their secrets: ``doc_id``, ``text_hash``, ``base``, ``added`` and ``live`` spans.

    ``base`` holds the spans of the fixed kinds, whatever their frequency.  ``added`` holds mixed strings that no
    more than ``most_owners`` owners in ``most_repositories`` repositories have.  ``live`` repeats those of both that look
    live: owner-specific ones, not widely copied examples (each list in order).  Owner and repository default to the columns ``source`` and
    ``source`` with ``lang``; a null owner is an owner of its own.  Null and empty texts have no spans; every
    input row gives one row.  Offsets are code points, ends exclusive.  The work on a text grows with its length and its
    matches, not with the square of either.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    found = staged(candidates(docs, text_col=text_col, id_col=id_col, owner=owner, repository=repository), "secret-candidates")
    tasks = tasks_for(found)
    owned = ownership(found, tasks).where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("secret")
    with_any = found.where((F.size("base") > 0) | (F.size("more") > 0))
    named = with_any.select(
        F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.posexplode(F.concat("base.value", "more.value")).alias("number", "value")
    ).select("k_id", "k_hash", "number", F.sha2("value", 256).alias("secret"))
    live = named.join(owned, "secret").coalesce(tasks).groupBy("k_id", "k_hash").agg(F.array_sort(F.collect_set("number")).alias("owned"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    judged = found.join(live, same, "left").withColumn("owned", F.coalesce("owned", F.array().cast("array<int>")))
    n = F.size("base")
    added = F.transform(F.filter("owned", lambda i: i >= n), lambda i: F.get("more", i - n))
    both = let(F.concat("base", "more"), lambda spans: F.transform("owned", lambda i: F.get(spans, i)))
    return judged.select("doc_id", "text_hash", "base", added.alias("added"), F.array_sort(both).alias("live")).coalesce(tasks)


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined, in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask_secrets(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", mark: str = "[secret]", **options) -> DataFrame:
    """The documents with each span of a secret (base and added) replaced by ``mark``; all columns kept.

    Overlapping spans are replaced once.  Documents without secrets, null texts included, stay as they are.
    """
    scanned = scan_secrets(docs, text_col=text_col, id_col=id_col, **options)
    spans = F.array_sort(F.concat("base", "added"))
    tasks = tasks_for(docs)
    s_id, s_hash, s_spans = (unused(docs, c) for c in ("span_id", "span_hash", "spans"))
    hits = staged(
        scanned.select(F.col("doc_id").alias(s_id), F.col("text_hash").alias(s_hash), spans.alias(s_spans))
        .where(F.size(s_spans) > 0)
        .dropDuplicates([s_id, s_hash])
        .coalesce(tasks),
        "secret-spans",
    )
    same = docs[id_col].eqNullSafe(F.col(s_id)) & (F.xxhash64(docs[text_col]) == F.col(s_hash))
    text = docs[text_col]
    reach = running(F.transform(s_spans, lambda s: s["byte_stop"]), lambda a, x: F.greatest(a, x), F.lit(0))

    def masked(bytes_: Column, ends: Column) -> Column:
        """What lies between the spans, cut from the bytes (a string would be counted through from its start each time)."""
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        part = lambda s, i: F.when(
            s["byte"] >= before(i), F.concat(F.substring(bytes_, before(i) + 1, s["byte"] - before(i)).cast("string"), F.lit(mark))
        ).otherwise(F.lit(""))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(F.transform(s_spans, part), ""), F.substring(bytes_, last + 1, F.length(bytes_)).cast("string"))

    cut = let(text.cast("binary"), lambda b: let(reach, lambda ends: masked(b, ends)))
    joined = docs.join(hits, same, "left").coalesce(tasks)
    return joined.withColumn(text_col, F.when(F.col(s_spans).isNotNull(), cut).otherwise(text)).drop(s_id, s_hash, s_spans)
