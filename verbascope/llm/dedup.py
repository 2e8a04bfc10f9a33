"""Near-duplicate documents by Order MinHash and banded alignment.

Sketch: a text's word runs of length ``k`` are labelled with how often the
same run came before. For each of ``items`` hash functions the ``ell`` labelled
runs of least hash are taken and put back into text order; their hash in that
order is one item. Two texts share an item with a probability near the
Jaccard similarity of their labelled runs to the power ``ell`` if those runs
also keep their order, so the sketch follows edit similarity.

Candidates share an item. First each text is compared with up to ``LEADERS``
leaders, the first members of most of its buckets, which joins groups of copies
at a cost in proportion to their rows; that is done ``LEADER_ROUNDS`` times
with other leaders. What is then left in buckets of several classes, of whatever size, is
compared to the end: a link needs so many words in common that two linked
texts share one of their rarest words (the prefix filter of similarity joins),
so the texts meet by those words, in lists that are made distinct before they
become pairs. A word at which a text has fewer words left, from it to the end
of the order, than a link of these two lengths needs in common isn't the first
that a linked pair shares, so nothing is paired by it (the positional filter).
Every pair that shares an item is thus connected, ruled out by
its lengths or its rarest words, or aligned.

Check: word edit distance of at most (1 - similarity) of the longer text. What
both texts begin and end with is taken off, and the rest is aligned within a
band that widens until a path cheap enough is found, or none can be. This also
holds for nearly all pairs whose sets of five-word runs have a Jaccard
similarity of that much, and for texts with edits strewn over them, which that
measure misses. Verified links are closed to classes.

Cost: a group of m texts that are all close to the threshold from each other
without being alike has up to m * m / 2 pairs that nothing but an alignment
can tell apart; they are all aligned.

Defined cases: equal texts are one class whatever their length; a null text
is in no class but that of its own doc_id; texts that differ in white space
only are alike; a text without words is alike to equal texts only; a null
doc_id gets a class like any other, named by the smallest id of the class
that isn't null. A class is named by its smallest doc_id; of several texts
with that id the one of least digest counts. ``kept`` holds for that document,
and for all rows that repeat its id and text. Very long texts are sketched and
aligned whole. An empty table gives no rows; columns other than doc_id and
text are neither read nor in the way, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbascope.llm.common import Shelf, give_up, over_batches, salt, salts, split, stored, table

#: Words to a run, runs to an item, items to a sketch; least similarity of a link.
K, ELL, ITEMS, SIMILARITY = 5, 3, 24, 0.8
#: A worker forgets word hashes beyond so many.
MEMORY = 20_000
#: Times that each text is compared with leaders before all that is left is compared, and leaders each time, at most.
LEADER_ROUNDS, LEADERS = 2, 4
#: Slots of the counts that order words by how rare they are; 8 bytes each.
SLOTS = 1 << 20
#: Slots of the classes that have a word at a length, 8 bytes each, and the ratio of lengths that count as one.
MET, RATIO = 1 << 21, 1.15
#: Members to a list of the texts that have a rare word.
LISTED = 1024
#: Texts that are left to a task.
DEALT = 256
#: Cells of a row, and words of a side, that a block of alignments may have; words that a task remembers.
BLOCK, SIDE, REMEMBERED = 1 << 14, 1 << 20, 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads its input."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[str]:
    return text.split()


class Sketcher:
    """Sketches of texts; one for each task."""

    def __init__(self, k: int = K, ell: int = ELL, items: int = ITEMS):
        self.k, self.ell, self.items = k, ell, items
        self.seeds = mixed(np.arange(1, items + 1, dtype=np.uint64) * ODD) | np.uint64(1)
        self.names = mixed(np.arange(1, items + 1, dtype=np.uint64))
        self.known = WordHash()

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def labelled(self, h: np.ndarray) -> np.ndarray:
        """A hash of each run of words and of how often it came before."""
        runs = np.zeros(max(1, len(h) - self.k + 1), np.uint64)
        for j in range(min(self.k, len(h))):
            runs = mixed(runs * ODD + h[j : j + len(runs)])
        order = np.argsort(runs, kind="stable")
        ranked = runs[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        place = np.arange(len(runs))
        before = place - np.maximum.accumulate(np.where(first, place, 0))
        out = np.empty_like(runs)
        out[order] = mixed(ranked + before.astype(np.uint64) * ODD)
        return out

    def least(self, order: np.ndarray) -> np.ndarray:
        """The places of the ``ell`` least numbers of each row; in a long row only those under a bound are sorted, where enough are."""
        n = order.shape[1]
        if n > 128:
            rows, places = np.nonzero(order < np.uint64((1 << 64) // n * (self.ell + 9)))
            many = np.bincount(rows, minlength=len(order))
            if many.min() >= self.ell:
                ranked = np.lexsort((order[rows, places], rows))
                starts = np.cumsum(many) - many
                return places[ranked[starts[:, None] + np.arange(self.ell)]]
        return np.argpartition(order, self.ell - 1, axis=1)[:, : self.ell]

    def __call__(self, words: list[str]) -> np.ndarray:
        """One number for each hash function; none for a text without words."""
        if not words:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            runs = self.labelled(self.hashes(words))
            if len(runs) > self.ell:
                least = np.sort(self.least(runs[None, :] * self.seeds[:, None]), axis=1)
                chosen = runs[least]
            else:
                chosen = np.broadcast_to(runs, (self.items, len(runs)))
            out = self.names.copy()
            for j in range(chosen.shape[1]):
                out = mixed(out * ODD + chosen[:, j])
        return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], bands: list[int]) -> np.ndarray:
    """Word edit distance of each pair, exact up to its band; more than the band means beyond it."""
    out = np.full(len(pairs), 1 << 30, np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]).bit_length(), bands[i]), reverse=True)
    at = 0
    while at < len(order):
        longest = 1 << len(pairs[order[at]][0]).bit_length()
        block = order[at : at + max(1, min(BLOCK // (2 * bands[order[at]] + 1), SIDE // longest))]
        at += len(block)
        band = max(bands[i] for i in block)
        for i, d in zip(block, _aligned([pairs[i] for i in block], band), strict=True):
            out[i] = d
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> list[int]:
    """Cells of one row of the table within the band, for all pairs at once; the column of cell j in row i is i + j - band."""
    n = max(len(a) for a, _ in pairs)
    width = 2 * band + 1
    a = np.full((len(pairs), n), -1, np.int32)
    b = np.full((len(pairs), n + width + 1), -2, np.int32)
    lengths = [(len(x), len(y)) for x, y in pairs]
    for r, (x, y) in enumerate(pairs):
        _, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
        a[r, : len(x)] = codes[: len(x)]
        inside = codes[len(x) :][: n + width + 1 - band]
        b[r, band : band + len(inside)] = inside
    far, steps = np.int32(1 << 28), np.arange(width, dtype=np.int32)
    row = np.where(steps < band, far, steps - band).astype(np.int32)[None, :].repeat(len(pairs), 0)
    found = [1 << 30] * len(pairs)

    def note(i: int) -> None:
        for r in by_length.get(i, ()):
            j = lengths[r][1] - i + band
            if 0 <= j < width:
                found[r] = int(row[r, j])

    by_length: dict[int, list[int]] = {}
    for r, (x, _) in enumerate(lengths):
        by_length.setdefault(x, []).append(r)
    note(0)
    up = np.full((len(pairs), width), far, np.int32)
    for i in range(1, n + 1):
        # cell j of row i has column i + j - band; its word of b stands at i + j - 1 in the padded rows
        new = row + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        up[:, :-1] = row[:, 1:] + 1
        np.minimum(new, up, out=new)
        if i <= band:
            new[:, : band - i] = far
            new[:, band - i] = i
        new -= steps
        row = np.minimum.accumulate(new, axis=1)
        row += steps
        note(i)
    return found


def bounds(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[int, int]:
    """The distance that the words without their order call for at least, and the largest that a link may have."""
    longer = max(len(a), len(b))
    values, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(codes[: len(a)], minlength=len(values)), np.bincount(codes[len(a) :], minlength=len(values))).sum()
    return longer - int(common), int((1 - similarity) * longer + 1e-9)


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with in common, which leaves their distance as it is."""
    for _ in range(2):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        same = int(differ[0]) if len(differ) else n
        a, b = a[same:][::-1], b[same:][::-1]
    return a, b


def linked(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> list[bool]:
    """Whether each pair of word sequences has an edit similarity of ``similarity`` or more.

    The cost of a path within any band bounds the distance from above, so a
    narrow band proves most links; only one as wide as the largest distance
    that counts disproves one.
    """
    out, left = [False] * len(pairs), []
    for i, (a, b) in enumerate(pairs):
        most, gap = int((1 - similarity) * max(len(a), len(b)) + 1e-9), abs(len(a) - len(b))
        if gap > most:
            continue
        a, b = trimmed(a, b)
        if max(len(a), len(b)) <= most:
            out[i] = True
        elif bounds(a, b, similarity)[0] <= most:
            left.append((i, (a, b), most, min(most, gap + 4)))
    while left:
        more = []
        for (i, pair, most, band), d in zip(left, distances([x[1] for x in left], [x[3] for x in left]), strict=True):
            if d <= most:
                out[i] = True
            elif band < most:
                more.append((i, pair, most, min(most, 4 * band)))
        left = more
    return out


def text_key(text: Column) -> Column:
    """Sixteen bytes for each text."""
    return F.unhex(F.md5(text.cast("binary")))


def sketches(docs: DataFrame, k: int = K, ell: int = ELL, items: int = ITEMS) -> DataFrame:
    """doc_id, key, n_words, items of every row whose text isn't null."""

    def make():
        sketch = Sketcher(k, ell, items)

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch["text"].to_pylist()
            words = [words_of(x) for x in texts]
            made = [sketch(x).view(np.int64) for x in words]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype("int32")
            return {
                "doc_id": batch["doc_id"], "key": [hashlib.md5(x.encode()).digest() for x in texts], "n_words": [len(x) for x in words],
                "items": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *made]))),
            }

        return step

    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).where("text IS NOT NULL")
    return over_batches(rows, "doc_id long, key binary, n_words int, items array<long>", make)


def meeting(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The ``rows`` (``key``, id, ...) whose ``key`` comes with several of ``value``.

    Counting combines before it shuffles, and the join back is on the key and
    a salt of the id, so that a key which a third of all rows share is split.
    """
    salted = rows.withColumn("salt", salt("id"))
    several = salted.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), salts()).where("low != high")
    return salted.join(split(several.select(key, "salts")), [key, "salt"]).drop("salt")


def with_leaders(members: DataFrame, turn: int) -> DataFrame:
    """The pairs (a, b) of each text with the leaders of most of its buckets, where those are of another class."""
    salted = members.withColumn("salt", salt("id"))
    order = F.xxhash64("id", F.lit(turn))
    first = salted.groupBy("item").agg(F.min_by("id", order).alias("b"), F.min_by("label", order).alias("b_label"), salts())
    led = salted.join(split(first), ["item", "salt"]).where("label != b_label")
    times = led.groupBy("id", "b").agg(F.count("*").alias("times"))
    # of equally frequent leaders any come first: which are compared in a round doesn't change the classes
    best = Window.partitionBy("id").orderBy(F.desc("times"), F.xxhash64("b"), "b")
    return times.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).select(F.col("id").alias("a"), "b")


class Remembered(dict):
    """Word hashes of the texts that came last, by id."""

    def __init__(self):
        self.known, self.words = WordHash(), 0

    def of(self, ident: int, text: str) -> np.ndarray:
        if (found := self.get(ident)) is None:
            words = words_of(text)
            found = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            if self.words > REMEMBERED:
                self.clear()
                self.words = 0
            self[ident] = found
            self.words += len(found)
        return found


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` that share an item and whose texts are similar.

    Each join is on one side's id, with the texts as they are once each; AQE
    splits the side of a leader whose pairs fill a partition.
    """
    left, right = (texts.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("text", "n_words", "items")]) for side in "ab")
    longest = F.greatest("n_words_a", "n_words_b")
    met = pairs.join(left, "a").join(right, "b").where(F.abs(F.col("n_words_a") - F.col("n_words_b")) <= F.floor((1 - similarity) * longest + 1e-9))
    met = met.where(F.arrays_overlap("items_a", "items_b"))

    def make():
        words = Remembered()

        def step(batch: pa.RecordBatch) -> dict:
            sides = [[words.of(*x) for x in zip(batch[c].to_pylist(), batch[f"text_{c}"].to_pylist(), strict=True)] for c in "ab"]
            return {"a": batch["a"], "b": batch["b"], "alike": linked(list(zip(*sides, strict=True)), similarity)}

        return step

    return over_batches(met.select("a", "b", "text_a", "text_b"), "a long, b long, alike boolean", make).where("alike").drop("alike")


def closed(labels: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """``labels`` (id, label) with one label for all that ``links`` (a, b) connect.

    Works on the graph of labels. Each round every label gives way to the least
    one near it, and the edges are carried over to those; edges within a label
    go, so the graph shrinks until none is left.
    """
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    edges = shelf.put(links.join(la, "a").join(lb, "b").where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    while not edges.isEmpty():
        near = edges.select("x", F.col("x").alias("to")).union(edges.select("y", "x"))
        parents = shelf.put(near.groupBy("x").agg(F.min("to").alias("up")), "parents")
        labels = labels.join(parents.select(F.col("x").alias("label"), "up"), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
        moved = edges.join(parents.select("x", F.col("up").alias("p")), "x").join(parents.select(F.col("x").alias("y"), F.col("up").alias("q")), "y").where("p != q")
        edges = shelf.put(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
    return shelf.put(labels, "labels")


def occurrences(words: np.ndarray) -> np.ndarray:
    """A number for each word and how often it came before."""
    with np.errstate(over="ignore"):
        return Sketcher(k=1).labelled(words) if len(words) else np.zeros(0, np.uint64)


def rarest(words: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The occurrences that come first in the order of ``counts``, so many that two linked texts have one of them in common."""
    found = occurrences(words)
    order = np.lexsort((found, counts[found % np.uint64(len(counts))]))
    return found[order[: int((1 - similarity) * len(found) + 1e-9) + 1]]


def length_keys(n: int, similarity: float) -> tuple[int, int]:
    """Two keys of a length: lengths that allow a link have one in common."""
    place = int(math.log(max(1, n)) / math.log(1.01 / similarity))
    return place, place + 1


def by_length(found: np.ndarray, key: int) -> np.ndarray:
    """The slots of occurrences in texts of a length key."""
    with np.errstate(over="ignore"):
        return (found + np.uint64(key) * ODD) % np.uint64(SLOTS)


def slot_counts(texts: DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of ``SLOTS`` numbers over ``texts`` (label, text).

    How many occurrences fall into each slot, 0 where all are of one class; and
    whether occurrences in texts of a length key are of several classes. A task
    sums its rows in arrays of that size, and the driver gets no more rows.
    """

    def run(batches):
        give_up()
        known, counts = WordHash(), np.zeros(2 * SLOTS, np.int32)
        low, high = np.full(2 * SLOTS, np.iinfo(np.int64).max), np.full(2 * SLOTS, np.iinfo(np.int64).min)
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                found = occurrences(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                plain = (found % np.uint64(SLOTS)).astype(np.int64)
                np.add.at(counts, plain, 1)
                for slots in (plain, *(SLOTS + by_length(found, k).astype(np.int64) for k in length_keys(len(words), similarity))):
                    low[slots], high[slots] = np.minimum(low[slots], label), np.maximum(high[slots], label)
        full = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, counts[full].astype(np.int64), low[full], high[full])], ["slot", "n", "low", "high"])

    sums = texts.select("label", "text").mapInArrow(run, "slot long, n long, low long, high long").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sums.where("low != high").select("slot", "n").toArrow()
    slots, n = found["slot"].to_numpy(), found["n"].to_numpy()
    counts, several = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool)
    counts[slots[slots < SLOTS]] = n[slots < SLOTS]
    several[slots[slots >= SLOTS] - SLOTS] = True
    return counts, several


def rare_words(words: np.ndarray, counts: np.ndarray, several: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those ``rarest`` occurrences that another class may have too, and their places in the order of all."""
    first = rarest(words, counts, similarity)
    # words that no other class has come first; nothing meets by them, nor by those of no other class at lengths that allow a link
    met = [several[by_length(first, k)] for k in length_keys(len(words), similarity)]
    places = np.flatnonzero((counts[first % np.uint64(SLOTS)] > 0) & (met[0] | met[1]))
    return first[places], places


def length_cells(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(1, n)) / math.log(RATIO)).astype(np.int64)


def at_cells(found: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The slots of occurrences in texts of these cells of lengths."""
    with np.errstate(over="ignore"):
        return (mixed(found + cells.astype(np.uint64) * ODD) % np.uint64(MET)).astype(np.int64)


def reached(found: np.ndarray, places: np.ndarray, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """How many slots each occurrence has, and the slots, of all lengths at which a text linked to one of ``n`` words may have the occurrences at ``places`` as the first in common."""
    # the longer of two linked texts has at most 1 / similarity times the words in common; a margin for logarithms
    low = length_cells(np.array([(n - int((1 - similarity) * n + 1e-9)) * (1 - 1e-9)]))[0]
    many = length_cells((n - places + 1e-9) / similarity * (1 + 1e-9)) - low + 1
    return many, at_cells(np.repeat(found, many), low + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))


#: What a slot holds that no class or several classes have; labels are not negative.
NO_CLASS, SEVERAL = -1, -2


def class_slots(texts: DataFrame, counts: np.ndarray, several: np.ndarray, similarity: float) -> np.ndarray:
    """The label of the class that has rare words of its texts' lengths in each of ``MET`` slots, for ``texts`` (label, text).

    Summed by tasks as in ``slot_counts``; a word is noted once a text, at its length.
    """

    def run(batches):
        give_up()
        known, low, high = WordHash(), np.full(MET, np.iinfo(np.int64).max), np.full(MET, np.iinfo(np.int64).min)
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                found, _ = rare_words(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), counts, several, similarity)
                slots = at_cells(found, length_cells(np.full(len(found), len(words))))
                low[slots], high[slots] = np.minimum(low[slots], label), np.maximum(high[slots], label)
        full = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, low[full], high[full])], ["slot", "low", "high"])

    sums = texts.select("label", "text").mapInArrow(run, "slot long, low long, high long").groupBy("slot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = sums.select("slot", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(SEVERAL)).alias("label")).toArrow()
    held = np.full(MET, NO_CLASS, np.int64)
    held[found["slot"].to_numpy()] = found["label"].to_numpy()
    return held


def meets(found: np.ndarray, places: np.ndarray, n: int, label: int, held: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a text of another class may have each occurrence as the first in common with this text of ``n`` words."""
    if not len(found):
        return np.zeros(0, bool)
    many, slots = reached(found, places, n, similarity)
    return np.logical_or.reduceat((held[slots] != NO_CLASS) & (held[slots] != label), np.cumsum(many) - many)


def left_pairs(members: DataFrame, texts: DataFrame, similarity: float, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) of the ``members`` (item, id, label) of different classes whose rarest words and lengths allow a link."""
    open_ids = members.select("id", "label").distinct()
    # their texts cost Python's time rather than bytes, so they are dealt by number and not packed by size
    tasks = -(-open_ids.count() // DEALT) or 1
    own = shelf.put(texts.join(open_ids, "id").select("id", "label", "n_words", "text").repartition(tasks, "id"), "open")
    counts, several = slot_counts(own, similarity)
    held = class_slots(own, counts, several, similarity)

    def make():
        known = WordHash()

        def step(batch: pa.RecordBatch) -> dict:
            made = []
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                found, places = rare_words(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), counts, several, similarity)
                # no word by which no text of another class can first meet this one
                kept = meets(found, places, len(words), label, held, similarity)
                found, places = found[kept], places[kept]
                made.append([{"word": w, "place": p} for w, p in zip(found.view(np.int64).tolist(), places.tolist(), strict=True)])
            return {**{c: batch[c] for c in ("id", "label", "n_words")}, "words": made}

        return step

    rare = over_batches(own, "id long, label long, n_words int, words array<struct<word: long, place: int>>", make)
    # a text's rarest occurrences differ from each other; one row each is written, as they are read twice
    rows = shelf.put(rare.select(F.explode("words").alias("words"), "id", "label", "n_words").select("words.word", "words.place", "id", "label", "n_words"), "rare-words")
    rows = shelf.put(meeting(rows, "word", "label"), "words")
    largest = rows.groupBy("word").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-largest // LISTED) or 1
    # the same block for a text in all lists, so what a text meets in a block is made distinct in one place
    block = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(blocks))
    lists = rows.withColumn("block", block).groupBy("word", "block").agg(F.collect_list(F.struct("id", "label", "n_words", "place")).alias("others"))

    def allowed(x: Column) -> Column:
        longer = F.greatest(x["n_words"], F.col("n_words"))
        # all that a linked pair has in common comes from its first common word on, in either text's order
        common = longer - F.floor((1 - similarity) * longer + 1e-9)
        return (x["id"] < F.col("id")) & (x["label"] != F.col("label")) & (x["n_words"] - x["place"] >= common) & (F.col("n_words") - F.col("place") >= common)

    met = rows.join(lists, "word").select("id", "block", F.transform(F.filter("others", allowed), lambda x: x["id"]).alias("met")).where(F.size("met") > 0)
    return met.groupBy("id", "block").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met")).select(F.col("id").alias("a"), F.explode("met").alias("b"))


#: Stands for a null doc_id where ids are compared; equal keys mean equal texts, so a real id of that value does no harm.
NO_ID = (1 << 63) - 1


def identified(docs: DataFrame) -> DataFrame:
    """Every row with a text: what it is, ``key`` of its text, and ``did``, its id or ``NO_ID``."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs.text.cast("string").alias("text"), text_key(docs.text).alias("key"), F.coalesce(docs.doc_id.cast("long"), F.lit(NO_ID)).alias("did")).where("key IS NOT NULL")


def classes(docs: DataFrame, similarity: float, shelf: Shelf) -> DataFrame:
    """key, did, salts, label of every different text of ``docs``; ``did`` is its least id, ``salts`` are its rows', and equal labels are classes."""
    rows = shelf.put(sketches(docs).withColumn("did", F.coalesce("doc_id", F.lit(NO_ID))), "sketches").withColumn("salt", salt("did"))
    # equal texts have equal items; columns of longs are aggregated by hash where arrays would be sorted
    firsts = [F.max(F.get("items", F.lit(j))).alias(f"item{j}") for j in range(ITEMS)]
    one = rows.groupBy("key").agg(F.min("did").alias("did"), F.max("n_words").alias("n_words"), salts(), *firsts)
    items = F.array_distinct(F.array_compact(F.array(*[f"item{j}" for j in range(ITEMS)]))).alias("items")
    # ids are written with their texts' keys and read from there, so they don't change
    one = shelf.put(one.select(F.monotonically_increasing_id().alias("id"), "key", "did", "n_words", "salts", items), "texts")
    members = shelf.put(meeting(one.select("id", F.explode("items").alias("item")), "item", "id").select("item", "id"), "members")
    labels = shelf.put(members.select("id").distinct().select("id", F.col("id").alias("label")), "labels")
    needed = one.join(labels.select("id"), "id").select("id", "key", "did", "n_words", "items")
    texts = shelf.put(identified(docs).select("key", "did", "text").join(needed, ["key", "did"]).dropDuplicates(["key", "did"]).select("id", "text", "n_words", "items"), "words")
    for turn in range(LEADER_ROUNDS + 1):
        # at first every text is a class of its own, and every bucket is open
        placed = members.select("item", "id").join(labels, "id") if turn else members.withColumn("label", F.col("id"))
        members = shelf.put(meeting(placed, "item", "label"), "open-members") if turn else placed
        if members.isEmpty():
            break
        pairs = with_leaders(members, turn) if turn < LEADER_ROUNDS else left_pairs(members, texts, similarity, shelf)
        labels = closed(labels, verified(pairs, texts, similarity), shelf)
    return one.join(labels, "id", "left").select("key", "did", "salts", F.coalesce("label", "id").alias("label"))


def winners(placed: DataFrame) -> DataFrame:
    """label, and the ``did`` and ``key`` of the document that names it."""
    return placed.groupBy("label").agg(F.min(F.struct("did", "key")).alias("first")).select("label", F.col("first.did").alias("first_did"), F.col("first.key").alias("first_key"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept of every row of ``docs``, from a table in the shared folder that is the caller's."""
    with Shelf(docs.sparkSession, "dedup") as shelf:
        placed = shelf.put(classes(docs, similarity, shelf).withColumnRenamed("salts", "copies").withColumn("salt", salt("key")), "classes")
        # large classes and large groups of copies are both joined by salts
        named = winners(placed).join(placed.groupBy("label").agg(salts()), "label")
        named = placed.join(split(named), ["label", "salt"]).select("key", "first_did", "first_key", F.col("copies").alias("salts"))
        rows = identified(docs).select("key", "did", salt("did").alias("salt"))
        out = rows.join(split(named), ["key", "salt"]).select(
            F.nullif("did", F.lit(NO_ID)).alias("doc_id"), F.nullif("first_did", F.lit(NO_ID)).alias("class_id"), ((F.col("did") == F.col("first_did")) & (F.col("key") == F.col("first_key"))).alias("kept")
        )
        untold = docs.where("text IS NULL").select(docs.doc_id.cast("long").alias("doc_id"))
        return stored(out.unionByName(untold.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))), "near-duplicates")


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns of ``docs``; rows without a text stay."""
    with Shelf(docs.sparkSession, "dedup") as shelf:
        won = stored(winners(classes(docs, similarity, shelf)).select(F.col("first_did").alias("did"), F.col("first_key").alias("key")), "dedup-winners")
    kept = identified(docs).select("row", "key", "did").join(won, ["key", "did"], "left_semi")
    return kept.dropDuplicates(["key", "did"]).select("row.*").unionByName(docs.where("text IS NULL"))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
