"""Line de-duplication with fuzzy matches, DataFrame functions only.

Lines are normalised (lower case, everything but letters and digits one blank). Equal lines form a
class, known by 128 bits of hash. A line's SimHash is made in blocks: one of 64 bits for each window of a
few words, in which a bit is set if most of the window's word pairs have it. An edit changes
the blocks of the windows it lies in and no other. That gives the pigeonhole: k edits leave at most k + 1
unedited pieces, so with at most 15 edits in 100 words one piece has 4 words or more, and a block of its
words stays as it is. (A SimHash of the whole line does not serve: one word of twenty changed flips about ten
of its 64 bits, and pigeonhole blocks that survive this are a few bits wide.) A line is dealt to its least blocks of 3
words, as many as make sure that no partner is missed (``needed_blocks``). Lines that share a block are candidates.

Why these are enough: a line that is alike differs by k edits at most. The least block that both have comes, in each of
the two, after spoilt ones only. An edit spoils 3 blocks at most, and of blocks without a common word one at most; so it
is among the first 3 * k + 1, and no later than the first by which k + 1 lie apart. This holds for any fixed order of
blocks: those that are met often, as a count over some lines says, come last, so lines that share only a common phrase
seldom meet.

Candidates are sifted by their length and their fold, 256 bits in which each word flips one: an edit moves
the length by one at most and flips two bits at most, so no line that is alike is lost. What is left is
verified by edit similarity (edits of words), and one occurrence of each connected group of lines stays:
the first, by document and place.

In a bucket each member first meets the bucket's first line or the one before it by length. Groups then still apart
meet in tiles of at most about ``TILE`` by ``TILE``, each pair in the first bucket that both lines are in: first by the two
lines that differ least, then, if still apart, by up to ``SLOTS`` pairs that pass the sieves, and only for groups that have more
pairs and are apart even then by all. So no link is lost.

Defined results: lines without letters and digits are left where they are; lines of fewer than
``FUZZY_WORDS`` words are matched exactly after normalising; a null text stays null, an empty one empty; a
text whose lines all go becomes empty; a row is known by its id and a hash of its text: rows with one id
and different texts are occurrences of their own, rows alike in both are cut alike; rows with a null id
keep all their lines; a line may have any number of words; other columns are carried along unread.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fence import once
from .graph import components
from .shared import columns, dropped, written

FUZZY_WORDS = 8
#: least edit similarity: 1 - edits of words / words of the longer line
SIMILARITY = 0.85
#: codes of words: as many as there are characters of UTF-16 below the surrogates
CODES = 0xD800
#: lowest bits of a block that give way to its place in the line
PLACE_BITS = 16
#: bits of the fold that is dealt with a line
MARK_BITS = 48
#: blocks tried, as multiples of those expected to be enough
TRIED = (1.0, 1.2)
#: members of a bucket on each side of a tile, and of a bucket that is not taken apart by length
TILE, FEW = 4096, 64
#: pairs at most that are kept for each two groups of lines that meet
SLOTS = 64
#: parts of 64 bits in a line's fold
FOLDS = 4
#: blocks met often that are dealt last, and the bits in which they are known: they decide the order only
OFTEN, OFTEN_BITS = 50_000, 1 << 20
#: one line of so many, by hash, is counted for these
COUNTED = 64


def normal(text: Column) -> Column:
    """A text in lower case, everything but letters and digits one blank in each line; blanks may stay at the ends of lines."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def coded(words: Column) -> Column:
    """A small number for each word, from its hash: ``CODES`` of them, around 0."""
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(CODES)) - CODES // 2).cast("smallint"))


def spelled(code: Column) -> Column:
    """The code with one character for each word, so that edits of these are edits of words."""
    return F.decode(F.unhex(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c + F.lit(CODES // 2)), 4, "0")), "")), "UTF-16BE")


def normal_lines(docs: DataFrame) -> DataFrame:
    """id, line, text of every line, normalised. ``docs``: id, text. The text is made once: no filter is moved into its making."""
    each = docs.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", F.posexplode(F.split(normal(F.col("text")), "\n", -1)).alias("line", "text"))
    return once(each.select("id", "line", F.trim("text").alias("text")))


def lines_of(docs: DataFrame) -> DataFrame:
    """id, line, words of every line."""
    return normal_lines(docs).select("id", "line", F.array_remove(F.split("text", " "), "").alias("words"))


def keyed(docs: DataFrame) -> DataFrame:
    """id, line, k1, k2, text of every line with words."""
    return normal_lines(docs).filter("text <> ''").select("id", "line", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def majority(features: list[Column]) -> Column:
    """The bits that more than half of the features have."""
    both = lambda a, b: a.bitwiseAND(b)
    return reduce(lambda a, b: a.bitwiseOR(b), [reduce(both, some) for some in combinations(features, len(features) // 2 + 1)])


def pairs_of(code: Column) -> Column:
    """Hashes of the adjacent words of a coded line."""
    many = F.size(code) - 1
    return F.zip_with(F.slice(code, F.lit(1), many), F.slice(code, F.lit(2), many), lambda a, b: F.xxhash64(a, b))


def simhash_blocks(pairs: Column, length: int) -> Column:
    """Hashes of the 64-bit SimHash blocks of all windows of ``length`` words, in order. ``pairs``: hashes of adjacent words."""
    many = max(1, length - 1)
    if many == 2:
        size = F.size(pairs) - 1
        return F.zip_with(F.slice(pairs, F.lit(1), size), F.slice(pairs, F.lit(2), size), lambda x, y: F.xxhash64(majority([x, y])))
    block = lambda i: F.xxhash64(majority([F.get(pairs, i + j) for j in range(many)]))
    return F.transform(F.sequence(F.lit(0), F.size(pairs) - many), block)


def often_part(h: Column) -> Column:
    """The number of the 64 bits in which a block is known as met often."""
    return F.shiftright(h, 6).bitwiseAND(F.lit(OFTEN_BITS // 64 - 1)).cast("int")


def ranked(blocks: Column, often: Column | None) -> Column:
    """The blocks as ranks, their highest bit set: those met often come last, without it. ``often``: bits, or None."""
    bit = lambda h: F.call_function("shiftright", F.get(often, often_part(h)), h.bitwiseAND(F.lit(63)).cast("int"))
    rank = lambda h: h.bitwiseOR(F.lit(-(1 << 63))).bitwiseXOR(F.shiftleft(bit(h), 63))
    return blocks if often is None else F.transform(blocks, rank)


def placed(blocks: Column) -> Column:
    """Blocks in their order, the lowest ``PLACE_BITS`` bits of each being its place in the line."""
    last = (1 << PLACE_BITS) - 1
    return F.sort_array(F.transform(blocks, lambda h, i: h.bitwiseAND(F.lit(~last)).bitwiseOR(F.least(i, F.lit(last)).cast("bigint"))))


def apart(blocks: Column, length: int) -> Column:
    """How many of the placed blocks of ``length`` words can lie apart from each other: as many edits at least spoil them all."""
    places = F.sort_array(F.transform(blocks, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))))
    free = lambda acc: acc.bitwiseAND(F.lit((1 << 20) - 1))
    taken = lambda acc, x: acc - free(acc) + F.lit(1 << 20) + x + F.lit(length)
    return F.shiftright(F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, x: F.when(x >= free(acc), taken(acc, x)).otherwise(acc)), 20)


def needed_blocks(blocks: Column, n: Column, length: int, least: float) -> Column:
    """How many of the placed blocks of a line of ``n`` words make sure that each line alike shares one: so many that the edits allowed cannot spoil all.

    A partner is at most as many words longer as it has edits, so there are at most n * (1 - least) / least of these;
    each spoils ``length`` blocks at most. Fewer blocks will do where that many lie apart, which is tried twice.
    """
    edits = F.floor(n * F.lit((1 - least) / least) + 1e-6)
    most, room = edits * length + 1, 1 - (length - 1) * (edits + 1) / F.size(blocks)
    tries = [F.least(most, F.ceil((edits + 1) * more / F.greatest(room, F.lit(0.01)))).cast("int") for more in TRIED]
    enough = [F.when(apart(F.slice(blocks, F.lit(1), some), length) > edits, some) for some in tries]
    return F.coalesce(*enough, most.cast("int"))


def folds(hashes: Column) -> Column:
    """``FOLDS`` * 64 bits in which each word flips one. ``hashes``: of the words."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(FOLDS - 1))
    flips = lambda j: lambda fold, h: F.when(part(h) == j, fold.bitwiseXOR(bit(h))).otherwise(fold)
    return F.array(*[F.aggregate(hashes, F.lit(0).cast("bigint"), flips(j)) for j in range(FOLDS)])


def short(length: int) -> int:
    """Words of the blocks that are dealt: one less than all that two alike lines share in one run, which thus holds two."""
    return length - 1 if length > 2 else length


def with_pairs(lines: DataFrame) -> DataFrame:
    """pairs in place of code; null where a line (n, code) has no fuzzy matches. Made once."""
    return once(lines.withColumn("pairs", F.when(F.col("n") >= FUZZY_WORDS, pairs_of(F.col("code")))).drop("code"))


def often_met(classes: DataFrame, length: int) -> Column:
    """Bits of the blocks that are met most often, counted on one line of ``COUNTED``, at most ``OFTEN``. They decide the order of blocks, no result.

    The first ones are found and turned into bits in the tasks: collected as blocks, each task would send the driver
    ``OFTEN`` of its own.
    """
    some = with_pairs(classes.filter((F.col("n") >= FUZZY_WORDS) & (F.pmod(F.xxhash64("code"), F.lit(COUNTED)) == 0)).select("n", "code"))
    counts = some.select(F.explode(F.array_distinct(simhash_blocks(F.col("pairs"), short(length)))).alias("h")).groupBy("h").count()
    first, bit = counts.filter("count > 1").orderBy(F.desc("count"), "h").limit(OFTEN), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    bits = [0] * (OFTEN_BITS // 64)
    for part, some in first.groupBy(often_part(F.col("h"))).agg(F.bit_or(bit)).collect():
        bits[part] = some
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def dealt_blocks(lines: DataFrame, length: int, least: float | None, often: Column | None = None) -> DataFrame:
    """The lines (n, code) with their blocks: all, or those needed to find all lines of edit similarity ``least``; null where there are no fuzzy matches."""
    each, fuzzy = with_pairs(lines), F.col("n") >= FUZZY_WORDS
    if least is None:
        return each.withColumn("blocks", F.when(fuzzy, F.array_distinct(simhash_blocks(F.col("pairs"), length)))).drop("pairs")
    size, found = short(length), F.col("found")
    each = once(each.withColumn("found", F.when(fuzzy, simhash_blocks(F.col("pairs"), size))).drop("pairs"))
    each = once(each.withColumn("found", placed(ranked(found, often))))
    some = F.slice(found, F.lit(1), needed_blocks(found, F.col("n"), size, least))
    return each.withColumn("blocks", F.when(fuzzy, F.array_distinct(F.transform(some, lambda x: F.shiftright(x, PLACE_BITS))))).drop("found")


def folded(lines: DataFrame) -> DataFrame:
    """The lines (n, code) with their fold."""
    each = once(lines.withColumn("hashes", F.transform("code", lambda c: F.xxhash64(c))))
    return each.withColumn("fold", folds(F.col("hashes"))).drop("hashes")


def marked(n: Column, code: Column) -> Column:
    """Length and a fold of ``MARK_BITS`` bits in one number, the length above (longer ones than there is room for as the longest)."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c, F.lit(MARK_BITS)).cast("int"))
    fold = F.aggregate(code, F.lit(0).cast("bigint"), lambda fold, c: fold.bitwiseXOR(bit(c)))
    return F.least(n, F.lit((1 << 63 - MARK_BITS) - 1)).cast("bigint") * F.lit(1 << MARK_BITS) + fold


def coded_lines(docs: DataFrame) -> DataFrame:
    """id, line, k1, k2, n (words), code of every line with words."""
    each = once(keyed(docs).select("id", "line", "k1", "k2", coded(F.split("text", " ")).alias("code")))
    return each.select("id", "line", "k1", "k2", F.size("code").alias("n"), "code")


def described(docs: DataFrame, length: int, least: float | None) -> DataFrame:
    """id, line, k1, k2, n, fold, blocks of every line with words. The blocks: see ``dealt_blocks``."""
    return dealt_blocks(folded(coded_lines(docs)), length, least)


def run_words(least: float) -> int:
    """Words that two lines of edit similarity ``least`` surely share in one run: the fewest over all lengths."""
    lengths = ((n, int((1 - least) * n + 1e-9)) for n in range(FUZZY_WORDS, 2000))
    return max(1, min(FUZZY_WORDS, *(-(-(n - k) // (k + 1)) for n, k in lengths)))


def alike(x: Column, y: Column, least: float) -> Column:
    """Edit similarity of at least ``least``, of two coded lines; edits beyond the bound are not counted on."""
    longer = F.greatest(F.length(x), F.length(y))
    bound = F.floor((1 - F.lit(least)) * longer + 1e-9).cast("int")
    return (F.abs(F.length(x) - F.length(y)) <= bound) & (F.call_function("levenshtein", x, y, bound) >= 0)


def flipped_bits(a: str, b: str, fold: str = "fold") -> Column:
    """Bits in which the folds of two marks differ."""
    return sum((F.bit_count(F.get(f"{a}.{fold}", F.lit(j)).bitwiseXOR(F.get(f"{b}.{fold}", F.lit(j)))) for j in range(FOLDS)), F.lit(0))


def bounds(a: str, b: str, least: float) -> tuple[Column, Column]:
    """The edits allowed between two lines, by their marks, and by how many words one is longer: so many edits at least are no exchanges."""
    return F.floor((1 - F.lit(least)) * F.greatest(f"{a}.n", f"{b}.n") + 1e-9), F.abs(F.col(f"{a}.n") - F.col(f"{b}.n"))


def near(a: str, b: str, least: float) -> Column:
    """Whether two members of a bucket, by their marks (n, fold), may be alike: an exchanged word flips two bits at most, one put in or left out flips one."""
    bound, longer = bounds(a, b, least)
    return (longer <= bound) & (flipped_bits(a, b) <= 2 * bound - longer)


def near_by_pairs(a: str, b: str, least: float) -> Column:
    """The same by the fold of the adjacent words: an exchanged word flips four bits at most, one put in or left out three."""
    bound, longer = bounds(a, b, least)
    return flipped_bits(a, b, "pair_fold") <= 4 * bound - longer


def near_marks(x: Column, y: Column, least: float) -> Column:
    """Whether two lines may be alike, by their ``marked`` numbers; false for null."""
    length = lambda m: F.shiftright(m, MARK_BITS)
    bound = F.floor((1 - F.lit(least)) * length(F.greatest(x, y)) + 1e-9)
    flipped, further = F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << MARK_BITS) - 1))), F.abs(length(x) - length(y))
    return F.coalesce((further <= bound) & (flipped <= 2 * bound - further), F.lit(False))


def verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) of classes that are alike."""
    near_ones = pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct()
    texts = written(classes.join(near_ones, "num", "left_semi").select("num", spelled(F.col("code")).alias("spelled")), "near-line-texts", small=True)
    x, y = (texts.select(F.col("num").alias(k), F.col("spelled").alias(f"text_{k}")) for k in "ab")
    links = written(pairs.join(x, "a").join(y, "b").filter(alike(F.col("text_a"), F.col("text_b"), least)).select("a", "b"), "line-links", small=True)
    dropped(texts)
    return links


def bucket_members(dealt: DataFrame, least: float) -> DataFrame:
    """bucket, num, a, several of the lines in blocks that more than one line has. ``dealt``: num, mark, blocks.

    ``a``: a line to compare with, by the marks the bucket's first, else the one before in length, else null. Lines
    alike are near in length, and so are those of a length between theirs: a line whose neighbours by
    length are not near has no partner in the bucket and goes. Where only two are near, their one pair is all there is to
    compare; ``several`` tells the others, that have more to meet. The rows are shuffled once; most go here.
    """
    order = Window.partitionBy("bucket").orderBy("mark", "num")
    each = dealt.select(F.explode("blocks").alias("bucket"), "num", "mark")
    shifted = [F.lag("mark", 2).over(order).alias("m_2"), F.lag("mark").over(order).alias("m_1"), F.lead("mark").over(order).alias("m1"), F.lead("mark", 2).over(order).alias("m2")]
    start = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("bucket", "num", "mark", *shifted, F.lag("num").over(order).alias("before"), F.first("num").over(start).alias("head"), F.first("mark").over(start).alias("m_head"))
    length = lambda m: F.shiftright(m, MARK_BITS)
    fits = lambda x, y: F.coalesce(length(y) - length(x) <= F.floor(F.lit(1 - least) * length(y) + 1e-9), F.lit(False))
    back, on = fits(F.col("m_1"), F.col("mark")), fits(F.col("mark"), F.col("m1"))
    each = each.filter(back | on)
    several = back & on | back & fits(F.col("m_2"), F.col("m_1")) | on & fits(F.col("m1"), F.col("m2"))
    meets = lambda num, mark: F.when((F.col(num) != F.col("num")) & near_marks(F.col(mark), F.col("mark"), least), F.col(num))
    each = each.select("bucket", "num", F.coalesce(meets("head", "m_head"), meets("before", "m_1")).alias("a"), several.alias("several"))
    return each.filter("several or a is not null")


def met_pairs(one: DataFrame, two: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs a, b of different components ca, cb (the lesser first) of two sides of tiles that pass the sieves, with the bits that differ.

    A pair is taken in the least bucket that both are in, so once. Where a bucket of both is not here, they were its
    only two that are near in length: they met there already.
    """
    x, y = (side.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in ("num", "component", "mark", "buckets")]) for k, side in (("a", one), ("b", two)))
    # the longer line is on the second side
    order = (F.col("mark_a.n") < F.col("mark_b.n")) | (F.col("mark_a.n") == F.col("mark_b.n")) & (F.col("num_a") < F.col("num_b"))
    sieves = near("mark_a", "mark_b", least) & near_by_pairs("mark_a", "mark_b", least)
    first = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
    pairs = x.join(y, keys).filter(order & (F.col("component_a") != F.col("component_b")) & sieves & first)
    ends = F.least("component_a", "component_b").alias("ca"), F.greatest("component_a", "component_b").alias("cb")
    return pairs.select(F.col("num_a").alias("a"), F.col("num_b").alias("b"), *ends, flipped_bits("mark_a", "mark_b").alias("flipped"))


def tiled_pairs(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The ``met_pairs`` within buckets. ``members``: bucket, num, component.

    A bucket of at most ``FEW`` is one tile, both sides of which are one shuffle. In larger ones lines are dealt to tiles by
    length, too: lines alike differ by the share 1 - ``least`` at most, so they are in one band of lengths or in two adjacent ones.
    """
    sizes = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"))
    still = members.join(sizes.filter("lo <> hi").select("bucket", F.when(F.col("many") > FEW, F.ceil(F.col("many") / TILE).cast("int")).alias("ways")), "bucket")
    per = still.groupBy("num").agg(F.first("component").alias("component"), F.collect_list(F.struct("bucket", "ways")).alias("tiles"))  # at most the blocks of a line
    marks = classes.select("num", "n", "code").join(per, "num")
    marks = once(folded(marks.withColumn("pairs", pairs_of(F.col("code")))))
    mark = F.struct("n", "fold", folds(F.col("pairs")).alias("pair_fold")).alias("mark")
    each = written(marks.select("num", "component", "tiles", mark), "line-tiles", small=True)
    each = each.select("num", "component", "mark", F.col("tiles.bucket").alias("buckets"), F.inline("tiles"))
    # shuffled once: both sides read the same rows
    small = each.filter("ways is null").drop("ways").repartition("bucket")
    pairs = met_pairs(small, small, ["bucket"], least)
    large = each.filter("ways is not null").withColumn("band", F.floor(F.log("mark.n") / F.lit(1.001 * max(-math.log(least), 1e-9))))
    place, all_ways = F.pmod(F.xxhash64("num"), F.col("ways")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1))
    one = large.withColumn("i", place).withColumn("j", all_ways)
    two = large.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("j", place).withColumn("i", all_ways)
    return pairs.unionByName(met_pairs(one, two, ["bucket", "band", "i", "j"], least))


def in_groups(rows: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """The rows with the component of the classes in ``column`` in its place; a class in no group is one of its own."""
    named = groups.select(F.col("id").alias(column), F.col("component").alias("_component"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_component", column)).drop("_component")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The ``groups`` (id, component), those that new ``links`` (a, b) of classes connect made one.

    Only components are linked anew, so the rounds this takes are over the new links, not over all links again.
    """
    into = written(components(in_groups(in_groups(links, groups, "a"), groups, "b")), "line-groups", small=True)
    moved = in_groups(groups, into, "component").select("id", "component")
    return written(moved.unionByName(into.join(groups, "id", "left_anti").select("id", "component")), "line-groups", small=True)


def fuzzy_groups(classes: DataFrame, least: float, blocks: str | None) -> DataFrame:
    """id, component of the classes that have near lines: both numbers of classes. ``classes``: num, n, code.

    What the first meeting leaves apart meets in tiles. Of each two components that do so, the two lines that differ least
    are compared first: groups that are one are then one, and only for those still apart are all their pairs taken.
    """
    length = run_words(least)
    needed = blocks == "needed"
    fuzzy = classes.filter(F.col("n") >= FUZZY_WORDS).select("num", "n", marked(F.col("n"), F.col("code")).alias("mark"), "code")
    dealt = dealt_blocks(fuzzy, length, least if needed else None, often_met(classes, length) if needed else None)
    members = written(bucket_members(dealt, least), "line-bucket-members")
    links = verified(written(members.filter("a is not null").select("a", F.col("num").alias("b")).distinct(), "line-pairs", small=True), classes, least)
    groups = written(components(links), "line-groups", small=True)
    several = members.filter("several").select("bucket", "num", F.col("num").alias("component"))
    slot = F.pmod(F.xxhash64("a", "b"), F.lit(SLOTS)).alias("slot")
    pairs = tiled_pairs(in_groups(several, groups, "component"), classes, least).groupBy("ca", "cb", slot)
    pairs = written(pairs.agg(F.min_by("a", "flipped").alias("a"), F.min_by("b", "flipped").alias("b"), F.min("flipped").alias("flipped"), F.count("*").alias("pairs")), "line-pairs", small=True)
    apart_yet = lambda: in_groups(in_groups(pairs, groups, "ca"), groups, "cb").filter("ca <> cb")
    if not pairs.isEmpty():
        best = pairs.groupBy("ca", "cb").agg(F.min_by("a", "flipped").alias("a"), F.min_by("b", "flipped").alias("b"), F.sum("pairs").alias("pairs"))
        best = written(best, "line-pairs", small=True)
        groups = joined(groups, verified(best.select("a", "b"), classes, least))
        more = written(apart_yet().select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), "line-pairs", small=True)
        if not more.isEmpty():
            groups = joined(groups, verified(more, classes, least))
    # what more than one pair of a slot leaves open
    rest = written(apart_yet().filter("pairs > 1").select(F.explode(F.array("ca", "cb")).alias("component")).distinct(), "line-groups", small=True)
    if not rest.isEmpty():
        rest = tiled_pairs(in_groups(several, groups, "component").join(rest, "component", "left_semi"), classes, least)
        rest = written(rest.select("a", "b"), "line-pairs", small=True)
        groups = joined(groups, verified(rest, classes, least))
    dropped(members)
    return groups


def removed_lines(docs: DataFrame, least: float = SIMILARITY, blocks: str | None = "needed") -> DataFrame:
    """id, text_hash, line of every occurrence that goes. ``docs``: id, text. ``blocks``: those "needed", or None for all; both find the same."""
    docs = docs.filter(F.col("id").isNotNull()).select(F.struct("id", F.xxhash64("text").alias("text_hash")).alias("id"), "text")
    first = coded_lines(docs).groupBy("k1", "k2").agg(F.min(F.struct("id", "line")).alias("v"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("code").alias("code"))
    # numbered as they are written, so the numbers stay
    classes = written(first.withColumn("num", F.monotonically_increasing_id()), "line-classes")
    groups = fuzzy_groups(classes.select("num", "n", "code"), least, blocks)
    both = written(classes.select(F.col("num").alias("id"), "k1", "k2", "v").join(groups, "id"), "line-groups", small=True)
    heads = both.groupBy("component").agg(F.min("v").alias("head"))
    # classes of one line in no group lose nothing
    alone = classes.filter("copies > 1").join(groups, F.col("num") == F.col("id"), "left_anti").select("k1", "k2", F.col("v").alias("head"))
    head = alone.unionByName(both.join(heads, "component").select("k1", "k2", "head"))
    lines = keyed(docs).select("id", "line", "k1", "k2")
    gone = lines.join(head, ["k1", "k2"]).filter(F.struct("id", "line") != F.col("head")).select("id.id", "id.text_hash", "line")
    gone = written(gone, "removed-lines", small=True)
    dropped(classes, groups, both)
    return gone


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, blocks: str | None = "needed") -> DataFrame:
    """The rows with all their columns, the text without its removed lines, and n_lines, n_removed (columns of these names give way)."""
    rows = columns(docs, id=id_col, text=text_col)
    gone = removed_lines(rows, least, blocks).groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_text")).agg(F.collect_set("line").alias("_lines"))  # at most the lines of one text
    text = F.col(f"`{text_col}`")
    both = docs.join(gone, (docs[id_col] == F.col("_id")) & (F.xxhash64(text) == F.col("_text")), "left")
    split = F.split(text, "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_lines"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(split, i)), "\n")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return both.select(
        *[F.when(F.col("_lines").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_removed"))
