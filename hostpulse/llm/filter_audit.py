"""How filters interact: what each removes in every order, read from path counts over the lattice of applied filters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The word separator, the capitals and the marks of the text filters.
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = r"[#$%&*|]"
#: Least words, least percentage of distinct words, most percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Stands for the filter that fails on a text which also belongs to a smaller id.
DUPLICATE = None


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text: few words, repeated words, many capitals, marks; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, BLANKS), lambda w: w != F.lit(""))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": distinct * F.lit(100).cast("long") < n * F.lit(LEAST_DISTINCT).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.length(whole) * F.lit(MOST_CAPITALS).cast("long"),
        "D": whole.rlike(MARKS),
    }


def paths(n: int) -> tuple[list[int], list[int]]:
    """For every set of applied filters (a bit each): orders that reach it from none, and that lead from it to all."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def failures(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None], *, part: Column, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Documents by ``part`` and ``mask`` of the filters they fail: ``n``, ``good`` and ``toxic``.

    Equal rows are combined first, then the labels join by id, then documents of equal text meet by its digest: as one row per
    part and label, which carries the smallest id and how many rows have it.  So neither a text nor an id that a third of all rows
    share gathers in a task.  Null ids have no label and are neither smaller nor greater than any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values()) if c is not DUPLICATE]
    own = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own.alias("mask")
    )
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1024))).otherwise(F.lit(0))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", spread)
    marked = labels.where("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic")
    )
    no = F.lit(False)
    rows = rows.join(marked.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").select(
        "part", "digest", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "id"
    )
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(named).alias("least")
    )
    for again in (1 << i for i, c in enumerate(filters.values()) if c is DUPLICATE):
        smallest = F.min("least.id").over(Window.partitionBy("digest"))
        first = F.col("nameless") + F.when(F.col("least.id") == F.col("smallest"), F.col("least.n")).otherwise(0)
        halves = F.array(
            F.struct(F.col("mask"), F.col("first").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(again)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
        )
        texts = texts.withColumn("smallest", smallest).withColumn("first", F.coalesce(first, F.lit(0)))
        texts = texts.select("part", "good", "toxic", F.inline(halves)).where("n > 0")
    of = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label)
    return texts.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(failed: DataFrame, names: str) -> DataFrame:
    """Every order of the filters ``names`` (a letter each), step by step, per part; ``failed`` as ``failures`` returns it.

    A state is the set of filters applied so far; an edge applies one more.  Per part a row holds what each state keeps (at most one
    entry per set of failed filters is collected for it), and so what each edge removes.  The orders through an edge are those
    that reach its state times those that lead on from its end: they weight its removals in ``shapley``, the sum over all orders.
    Each step of an order is one of the edges.
    """
    count = len(names)
    states = 1 << count
    forward, backward = paths(count)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    parts = failed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))

    def total(keep) -> Column:
        zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))
        return F.aggregate(F.filter("sets", keep), zero, lambda a, m: F.struct(*((a[c] + m[c]).alias(c) for c in ("n", "good", "toxic"))))

    left = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: total(lambda m: m["mask"].bitwiseAND(s) == 0))
    parts = parts.withColumn("left", left)
    bit = F.element_at(longs(1 << f for f in range(count)), F.col("f") + 1).cast("int")
    each = parts.select("part", "sets", "left", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("f")).withColumn("bit", bit)
    at = lambda state: F.get("left", state)
    ways = lambda state: F.get(longs(forward), state) * F.get(longs(backward), state.bitwiseOR(F.col("bit")))
    before = F.filter(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    gone = lambda state: at(state)["n"] - at(state.bitwiseOR(F.col("bit")))["n"]
    weighted = F.aggregate(before, F.lit(0).cast("long"), lambda a, s: a + ways(s) * gone(s))
    each = each.select(
        "part", "left", "f", "bit", weighted.alias("shapley"), before.alias("before"),
        total(lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0)["n"].alias("fails"),
        total(lambda m: m["mask"] == F.col("bit"))["n"].alias("unique_fails"),
    )
    edges = each.select("*", F.explode("before").alias("state")).withColumn("from", at(F.col("state"))).withColumn("to", at(F.col("state").bitwiseOR(F.col("bit"))))
    lost = lambda c: F.col(f"from.{c}") - F.col(f"to.{c}")
    edges = edges.select(
        "part", "f", "state", "unique_fails", "shapley", F.col("to.n").alias("kept"), lost("n").alias("removed"),
        (F.col("fails") - lost("n")).alias("redundant"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    steps = []
    for order in permutations(range(count)):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[i] for i in order), step, f, state))
            state |= 1 << f
    walk = failed.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, state int")
    # the steps of all orders: their number depends on the filters alone
    return edges.join(F.broadcast(walk), ["f", "state"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """The audit of the text filters A to D and of the duplicate filter E over whole documents, per ``part_col``.

    One row per part, order of the filters and step, with long counts of the part's documents: ``kept``, ``removed``, ``redundant`` (fail the
    step's filter but were removed earlier), ``unique_fails`` (fail this filter only), ``good_lost``, ``toxic_lost`` and ``shapley``.  A
    null text is an empty one, a null part the part ''.  Rows that repeat an id and a text count as often as they stand there and
    are not duplicates of each other; an id is good or toxic if any of its labels says so.  Very long texts are read whole, in the
    row's task.  An empty table gives no rows; other columns are ignored.
    """
    filters = {**text_filters(F.col(text_col)), "E": DUPLICATE}
    narrow = docs.select(F.col(id_col), F.col(text_col), F.col(part_col))
    return audit(failures(narrow, labels, filters, part=F.col(part_col), text_col=text_col, id_col=id_col), "".join(filters))
