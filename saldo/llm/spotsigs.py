"""SpotSigs document fingerprints. DataFrame functions only.

A text's common words are anchors; the content words after an anchor, anchors skipped, form a chain of
CHAIN words, and anchor and chain together one spot signature. A text's signature set is its fingerprint.
The start of the text counts as an anchor, so a text without common words still has a signature.
Two sets whose sizes differ by more than the likeness asked for allows can't reach it: sets are
partitioned by length, only sets of the same or the neighbouring partition are compared, and within
those an index on each set's first signatures in a fixed order (prefix filter) prunes pairs before the
Jaccard likeness is computed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saldo.llm.common import checkpointed, connected_components

CHAIN = 3
#: Text per range of neighbouring documents and per partition of ranges, in characters, and most ranges.
RANGE_CHARS = 1_000_000
PART_CHARS = 64_000_000
MAX_RANGES = 100_000
_SUB = 1 << 20
MARK = "\x01"
#: Anchors: frequent function words of English, French, German and Spanish. Fixed values.
ANCHORS = (
    "a an and are as at be by can do for from had has have he in is it not of on or she that the they this to was were will with you "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "auf das dem den der die ein eine er es für im ist mit nicht sich sie und von zu "
    "al con del el las lo los no para por y"
).split()


def _trie(words: list[str]) -> str:
    """A regular expression that matches any of the words, branching once per letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    some = [c + _trie(rest) for c, rest in heads.items() if c]
    body = some[0] if len(some) == 1 else "(?:" + "|".join(some) + ")"
    if not some:
        return ""
    return f"(?:{body})?+" if "" in heads else body


def signatures(docs: DataFrame, text: str, out: str, *, anchors: tuple[str, ...] | list[str] = tuple(ANCHORS), chain: int = CHAIN) -> DataFrame:
    """docs with the sorted distinct signatures (array<int>) of a text column; null and empty texts have none.

    Words are runs of letters and digits, lower-cased. A text that has words but no content word gets one
    signature of its whole word sequence. An array column `out` of docs is replaced.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    marked = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), f"(?<= )({_trie(list(anchors))}) ", f"$1{MARK}")
    step = docs.withColumn("_spot", F.split(F.trim(marked), " "))
    step = step.withColumn("_word", F.transform("_spot", lambda w: F.substring_index(w, MARK, -1)))

    def at(w: Column, i: Column) -> Column:
        links = F.concat_ws(" ", *[F.get(F.col("_word"), i + k) for k in range(chain)])  # slice() would copy the whole array each time
        before = F.when(i == 0, F.concat(F.lit("^" + MARK), w)).otherwise(w)
        spots = F.split(before, MARK)
        some = F.transform(F.slice(spots, 1, F.size(spots) - 1), lambda a: F.hash(a, links))
        whole = F.when((i == 0) & w.endswith(MARK), F.array(F.hash(F.lit("^"), w)))  # anchors and nothing else
        return whole.when(((i == 0) | (F.instr(w, MARK) > 0)) & ~w.endswith(MARK), some).otherwise(F.array().cast("array<int>"))

    found = F.flatten(F.transform("_spot", at))
    return step.withColumn(out, F.when(F.element_at("_spot", 1) == "", F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(found)))).drop("_spot", "_word")


def fingerprint(sigs: Column) -> Column:
    """The signature set as text: eight hex digits each, in the set's order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets, 0 where their sizes alone keep it below `floor`. Two empty sets: 1."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < floor * large), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _array(values, kind: str) -> Column:
    """An array as one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _below(cuts: list[int], value: Column) -> Column:
    """Number of cuts (ascending) below a value, by bisection."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    have = _array(cuts, "long")
    step = lambda n, s: F.when((n + s <= len(cuts)) & (F.get(have, n + s - 1) < value), n + s).otherwise(n)
    return F.aggregate(_array(steps, "int"), F.lit(0), step) if cuts else F.lit(0)


def with_next(docs: DataFrame, carry: list[str], *, text: str, id_col: str, prepare: Callable[[DataFrame], DataFrame] | None = None, range_chars: int = RANGE_CHARS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """docs with, as next_<c>, the columns `carry` of the next row by descending id; the first row follows the last.

    Rows of one id follow each other by a hash of their text, then by text; rows without an id come last.
    prepare adds columns to rows once they are dealt out, on both rows and their successors.

    Ids are cut into ranges at their quantiles, an id that spans several quantiles by its texts' hashes. A
    row's range is found by bisection, the window runs within a range, and a copy of the next range's head
    row joins it as a guest. There are many small ranges a partition, so that partitions come out even. The
    driver holds a cut, a head id and a place for each range, max_ranges at most; larger tables have larger ranges.
    """
    spark = docs.sparkSession
    own = F.col(id_col).cast("long")
    stats = docs.agg(F.sum(F.length(text)).alias("chars"), F.count(F.lit(1)).alias("rows"), F.count(own).alias("known")).first()
    chars = stats["chars"] or 0
    ranges = max(1, min(int(chars // range_chars) + 1, max_ranges, stats["rows"]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(chars // PART_CHARS) + 1)
    found = docs.agg(F.percentile_approx(own, _array([k / ranges for k in range(1, ranges)], "double"), 4 * ranges).alias("q")).first()["q"] if ranges > 1 else []
    spans = Counter(found or [])
    cuts = sorted(spans)
    nulls = -(-(stats["rows"] - stats["known"]) * ranges // max(stats["rows"], 1))
    # ranges are numbered as rows follow each other: cut by cut downwards, and within a cut's id by the texts' hashes
    place = F.lit(len(cuts)) - _below(cuts, own)
    number = place.cast("long") * _SUB
    share = F.xxhash64(text) / F.lit(2.0**64) + 0.5
    if any(m > 1 for m in spans.values()):
        many, at = F.get(_array([spans[c] for c in cuts], "int"), len(cuts) - place), F.get(_array(cuts, "long"), len(cuts) - place)
        number = number + F.when(many > 1, F.when(own == at, F.least(F.floor(share * many), many - 1)).otherwise(many)).otherwise(0)
    if nulls:
        number = F.when(own.isNull(), F.lit((len(cuts) + 1) * _SUB) + F.least(F.floor(share * nulls), F.lit(nulls - 1))).otherwise(number)
    placed = docs.withColumn("_range", number.cast("long"))
    heads = sorted((r["_range"], r["h"]) for r in placed.groupBy("_range").agg(F.max(own).alias("h")).collect())
    seats = spark.createDataFrame([(rng, head, heads[k - 1][0]) for k, (rng, head) in enumerate(heads)], "_seat long, _head long, _host long")
    # the head of each range is a guest of the range before it, the very first of the last range
    guests = placed.join(F.broadcast(seats), (F.col("_range") == F.col("_seat")) & own.eqNullSafe(F.col("_head")))  # 24 bytes a range
    guests = guests.groupBy("_host").agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("_first"))
    guests = guests.select(F.col("_host").alias("_range"), F.col("_first.t").alias(text), F.lit(1).alias("_guest"))
    dealt = placed.withColumn("_guest", F.lit(0)).unionByName(guests, allowMissingColumns=True).repartition(parts, "_range")
    dealt = prepare(dealt) if prepare else dealt
    order = Window.partitionBy("_range").orderBy("_guest", F.desc_nulls_last(id_col), F.xxhash64(text), text)
    for c in carry:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where("_guest = 0").drop("_range", "_guest")


def similar_pairs(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links of likeness at least `threshold` between classes of equal signature sets, and each row's class.

    Returns (a, b, likeness) with a < b classes' smallest ids, and (id, class) per row of docs. Equal sets
    collapse first, so copies cost one row. Sets are partitioned by length in steps of 1 / threshold; a set
    meets those of its own and the next partition that share one of its rarest signatures (as many as a
    partner within the threshold can't miss all of) where enough of both sets is left behind it. Survivors
    are compared in full. Nothing is capped. Empty sets link with nothing; an empty table gives no rows.
    """
    rows = signatures(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_t")), "_t", "sigs").select("id", "sigs")
    rows = checkpointed(rows.withColumn("print", F.xxhash64("sigs")))  # signatures are read several times
    classes = checkpointed(rows.groupBy("print", "sigs").agg(F.min("id").alias("class")))
    members = rows.join(classes, ["print", "sigs"]).select("id", "class")
    sized = classes.where(F.size("sigs") > 0).select("class", "sigs", F.size("sigs").alias("n"))
    sized = sized.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int"))
    entry = sized.select("class", "n", "part", F.explode("sigs").alias("sig"))
    often = entry.groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    ranked = entry.join(often, "sig").groupBy("class", "n", "part").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("order"))  # a set's own signatures
    head = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    index = ranked.select("class", "n", "part", F.posexplode(F.slice("order", F.lit(1), head)).alias("pos", "s")).select("class", "n", "part", "pos", F.col("s.sig").alias("sig"))
    short = index.select(F.col("class").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    long_ = index.select(F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "sig", "part")
    fits = (F.col("na") >= threshold * F.col("nb") - 1e-9) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ca") < F.col("cb"))))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    maybe = short.join(long_, ["sig", "part"]).where(fits & left).select("ca", "cb").distinct()
    sets = lambda c, s: sized.select(F.col("class").alias(c), F.col("sigs").alias(s))
    pairs = maybe.join(sets("ca", "sa"), "ca").join(sets("cb", "sb"), "cb").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), threshold))
    pairs = pairs.where(F.col("likeness") >= threshold - 1e-12)
    return pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "likeness"), members


def links(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(id, class, n_links, component_id) per row of docs with an id: its class of equal signature sets, the rows it is linked with, and the smallest id reachable.

    Rows of a class are linked with each other (but for empty sets), and with all rows of classes similar_pairs finds.
    """
    pairs, members = similar_pairs(docs.where(F.col(id_col).isNotNull()), text=text, id_col=id_col, threshold=threshold)
    pairs, members = checkpointed(pairs.select("a", "b")), checkpointed(members)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    comps = connected_components(pairs).withColumnRenamed("node", "class")
    empty = docs.where(F.col(id_col).isNotNull() & (F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]+", " ")) == "")).agg(F.min(id_col).alias("class")).select("class", F.lit(True).alias("_none"))
    per = sizes.join(others, "class", "left").join(comps, "class", "left").join(empty, "class", "left")
    per = per.select("class", F.when(F.col("_none"), 0).otherwise(F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("_none"), None).otherwise(F.coalesce("component", "class")).alias("root"))
    return members.join(per, "class").select("id", "class", "n_links", F.coalesce("root", "id").alias("component_id"))
