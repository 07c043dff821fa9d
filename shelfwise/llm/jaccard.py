"""N-gram Jaccard join: grouped prefix join with exact verification.

A document's set holds its distinct word n-grams as 64-bit hashes. Two sets that
link share one of their *prefixes*: the first ``size - ceil(t size) + 1`` members in an
order common to all. The order puts frequent n-grams last, so that prefixes are rare.
Which ones are frequent is counted over the prefixes of all documents, and once more
over what prefixes grow into that held some; the counts decide the cost, never the result.

Equal sets are one *class*; classes of the same size and prefix are one *group*. Groups
that share a rare prefix member are paired under the size filter, pairs of groups are
expanded to pairs of classes, and their texts are compared exactly.

A frequent member that a prefix cannot avoid has a list of any length, and so may a
group be large (thousands of near copies). There every class is compared with one
pivot of the list first. What hangs together then needs no further comparison: only
classes outside the list's largest component are compared with the list, block by
block, and a block gives back at most one link per class and component. No pairs of a
list are emitted, and no list meets in one task.

Cases: texts that are null or hold no word have an empty set and link with nothing, also
not with each other. A text of fewer than ``n`` words is one member. Rows may repeat,
ids may repeat or be null: each row is a document; a null id is never a component's
name unless it has no other. An empty table gives an empty result. Of the input only
the id column is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.components import connected
from shelfwise.llm.pretokens import portions
from shelfwise.llm.words import VISIBLE, hashed_words, mixed
from shelfwise.llm.workers import ship_code, slices
from shelfwise.sources.scratch import staged

#: A prefix member in so many documents is frequent; more if that were over ``MOST_FREQUENT`` of them.
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Classes of a list that one task compares with as many others, and columns of the comparison's matrix.
BLOCK, COLUMNS = 512, 4096
_FILTER_BITS = 1 << 23


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    words = hashed_words(texts, VISIBLE)
    grams = np.zeros(max(len(words.hashes) - n + 1, 0), np.uint64)
    for i in range(n):
        grams = mixed(grams + words.hashes[i:len(words.hashes) - n + 1 + i] + np.uint64(i))
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a:b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            short = np.zeros(1, np.uint64)
            for i in range(a, b):
                short = mixed(short + words.hashes[i:i + 1] + np.uint64(i - a))
            out.append(mixed(short + np.uint64(b - a)) if b > a else short[:0])
    return out


def _class(own: np.ndarray) -> int:
    """A number for the set."""
    salted = mixed(own + np.uint64(77))
    total = np.array([len(own)], np.uint64) + salted.sum(dtype=np.uint64)
    return int(mixed(mixed(total) + np.bitwise_xor.reduce(own)).view(np.int64)[0])


def _of_share(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def _can_link(n1: str, n2: str, share: int) -> Column:
    return 100 * F.least(n1, n2) >= share * F.greatest(n1, n2)


class NGramJaccard:
    """Links where 100 x intersection >= ``share`` x union of the sets of word ``n``-grams."""

    def __init__(self, n: int = 5, share: int = 80):
        self.n, self.share = n, share

    def join(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``key``, n_shingles, component_id and class (null for empty sets) per row of ``docs``."""
        ship_code(docs.sparkSession)
        docs = docs.select(F.col(key), F.col(text).alias("text"))
        frequent = self._frequent(docs)
        scanned = staged(self._scan(docs, frequent).withColumn("group", F.xxhash64("n", "rare", "common")), "prefixes")
        members = staged(scanned.filter("n > 0").select("group", "class", "n").distinct(), "members")
        groups = (scanned.filter("n > 0").groupBy("group")
                  .agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("common").alias("common")))
        groups = staged(groups, "groups")
        lists = self._long_lists(groups, members)
        pivots = lists.groupBy("list").agg(F.min(F.struct("class", "n")).alias("pivot"))
        with_pivot = (lists.join(pivots, "list").filter(F.col("class") != F.col("pivot.class"))
                      .filter(_can_link("n", "pivot.n", self.share))
                      .select(F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b")))
        pairs = staged(self._short_pairs(groups, members).unionByName(with_pivot).distinct(), "pairs")
        near = staged(self._verified(docs, pairs), "near")
        roots = connected(near)
        roots = connected(near.unionByName(self._across(docs, lists, roots)))
        least = (scanned.filter("class is not null").groupBy("class").agg(F.min(key).alias("least"))
                 .join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
        named = staged(least.select("class", "root", "least"), "named")
        names = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id")
        alone = scanned.filter("class is null").withColumn("component_id", F.col(key))
        return (scanned.filter("class is not null").join(names, "class").select(key, "n", "component_id", "class")
                .unionByName(alone.select(key, "n", "component_id", "class")).withColumnRenamed("n", "n_shingles"))

    def _scan(self, docs: DataFrame, frequent: np.ndarray) -> DataFrame:
        key, n, share = docs.columns[0], self.n, self.share
        held = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT numbers

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for a, b in portions(texts, 1 << 20):
                    rows = [_prefix(own, held.value, share) for own in sets_of(texts[a:b], n)]
                    number, size, rare, common = zip(*rows)
                    as_lists = lambda parts: pa.ListArray.from_arrays(
                        np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32), np.concatenate(parts).view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(number, pa.int64()),
                                                      as_lists(rare), as_lists(common)], names=[key, "n", "class", "rare", "common"])

        kind = docs.schema[key].dataType.simpleString()
        return docs.mapInArrow(scan, f"`{key}` {kind}, n long, class long, rare array<long>, common array<long>")

    def _frequent(self, docs: DataFrame) -> np.ndarray:
        """High halves of members that are frequent in the prefixes of all documents, sorted.

        The second count also takes in what a prefix that held frequent members will grow into:
        three places for each of them, or the whole set if they were half of the prefix.
        """
        found = np.empty(0, np.uint32)
        for _ in range(2):
            counted = staged(self._halves(docs, found).groupBy("half").count().filter(F.col("count") >= FREQUENT), "frequent")
            limit = FREQUENT
            while (new := counted.filter(F.col("count") >= limit)).count() > MOST_FREQUENT // 2:
                limit *= 2
            found = np.union1d(found, np.array([r[0] for r in new.select("half").collect()], np.int32).view(np.uint32))
        return found

    def _halves(self, docs: DataFrame, frequent: np.ndarray) -> DataFrame:
        """The high half of each member of each prefix, and of more where the prefix held ``frequent`` ones. A task counts equal sets once."""
        n, share = self.n, self.share
        held = docs.sparkSession.sparkContext.broadcast(frequent)

        def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in slices(batches):
                texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
                for a, b in portions(texts, 1 << 20):
                    out = [np.empty(0, np.uint32)]
                    for own in sets_of(texts[a:b], n):
                        if len(own) and (name := _class(own)) not in seen:
                            seen.add(name)
                            half = (own >> np.uint64(32)).astype(np.uint32)
                            length = _of_share(len(own), share)
                            common = int(_is_in(half[:length], held.value).sum()) if len(held.value) else 0
                            out.append(half[:length + 2 * common + 8 if common else length] if 2 * common < length else half)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int32))], names=["half"])

        return docs.select("text").mapInArrow(halves, "half int")

    def _short_pairs(self, groups: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs of classes whose groups share a rare prefix member, and pairs within small groups.

        What two prefixes share bounds what the sets can share; most pairs of groups end there.
        """
        share = self.share
        lists = groups.select("group", "n", F.explode("rare").alias("member"))
        left = lists.select(F.col("group").alias("g1"), F.col("n").alias("n1"), "member")
        right = lists.select(F.col("group").alias("g2"), F.col("n").alias("n2"), "member")
        pairs = left.join(right, "member").filter("g1 < g2").filter(_can_link("n1", "n2", share)).select("g1", "g2").distinct()
        side = lambda i: groups.select(*[F.col(c).alias(c[0] + str(i)) for c in ("group", "n", "rare")], (F.size("common") > 0).alias(f"c{i}"))

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = ([np.asarray(v.values).view(np.uint64) for v in batch.column(c)] for c in ("r1", "r2"))
                rest = zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "c1", "c2")))
                stays = pa.array([c1 or c2 or _may_share(a, b, n1, n2, share) for a, b, (n1, n2, c1, c2) in zip(x, y, rest)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("g1").filter(stays), batch.column("g2").filter(stays)], names=["g1", "g2"])

        pairs = (pairs.join(side(1), "g1").join(side(2), "g2").select("g1", "g2", "n1", "n2", "r1", "r2", "c1", "c2")
                 .mapInArrow(likely, "g1 long, g2 long"))
        small = members.groupBy("group").count().filter(F.col("count").between(2, FREQUENT)).select(F.col("group").alias("g1"), F.col("group").alias("g2"))
        return (pairs.unionByName(small)
                .join(members.select(F.col("group").alias("g1"), F.col("class").alias("x")), "g1")
                .join(members.select(F.col("group").alias("g2"), F.col("class").alias("y")), "g2")
                .filter("g1 <> g2 or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))

    def _long_lists(self, groups: DataFrame, members: DataFrame) -> DataFrame:
        """(list, class, n): classes that share a frequent prefix member, and large groups."""
        large = members.groupBy("group").count().filter(F.col("count") > FREQUENT).select("group")
        lists = groups.select(F.explode("common").alias("list"), "group").unionByName(large.select(F.xxhash64("group", F.lit("group")).alias("list"), "group"))
        return lists.join(members, "group").select("list", "class", "n")

    def _texts(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(class, text), one text of each wanted class.

        A bitmap of fixed size keeps most other texts from being shuffled.
        """
        n, spark = self.n, docs.sparkSession
        place = F.pmod(F.col("class"), F.lit(_FILTER_BITS)) + 1  # Spark's bitmaps number their bits from 1
        words = (wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())  # 1 MB at most
        bits = np.zeros(_FILTER_BITS // 8, np.uint8)
        for bucket, part in words:
            bits[(bucket - 1) * len(part):bucket * len(part)] = np.frombuffer(part, np.uint8)
        held = spark.sparkContext.broadcast(bits)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.unpackbits(held.value, bitorder="little")
            for batch in slices(batches):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for a, b in portions(texts, 1 << 20):
                    rows = [(_class(own), t) for own, t in zip(sets_of(texts[a:b], n), texts[a:b]) if len(own)]
                    rows = [r for r in rows if known[r[0] % _FILTER_BITS]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                                     names=["class", "text"])

        return (docs.mapInArrow(named, "class long, text binary").join(wanted.distinct(), "class", "left_semi")
                .groupBy("class").agg(F.first("text").alias("text")))

    def _verified(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        n, share = self.n, self.share
        texts = staged(self._texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("class"))), "texts")
        both = (pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b"))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                a, b, left, right = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                own = dict(zip(a, left)) | dict(zip(b, right))
                sets: dict[int, np.ndarray] = {}
                names = list(own)
                for x, y in portions([own[c] for c in names], 1 << 20):
                    sets |= zip(names[x:y], sets_of([own[c] for c in names[x:y]], n))
                stays = [_links(_shared(sets[x], sets[y]), len(sets[x]), len(sets[y]), share) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(stays, pa.bool_())),
                                                  batch.column("b").filter(pa.array(stays, pa.bool_()))], names=["a", "b"])

        return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")

    def _across(self, docs: DataFrame, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """Links (a, b) between the components that meet in a long list.

        Everything outside a list's largest component is compared with all of the list.
        """
        n, share = self.n, self.share
        known = (lists.join(roots.withColumnRenamed("node", "class"), "class", "left")
                 .withColumn("root", F.coalesce("root", "class")))
        sizes = known.groupBy("list", "root").count()
        main = (sizes.groupBy("list").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
                .filter("roots > 1"))
        # Sizes that can link lie in the same or in neighbouring buckets.
        bucket = F.floor(F.log("n") / float(np.log(100 / share))).cast("int")
        # Lists with one largest component (those of a group of near copies) are one list from here on.
        members = staged(known.join(main, "list").withColumns({"bucket": bucket, "outside": F.col("root") != F.col("main")})
                         .select(F.col("main").alias("list"), "class", "root", "bucket", "outside").distinct(), "members")
        blocks = lambda rows, name: rows.groupBy("list", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        asked = members.filter("outside").withColumn("ask_bucket", F.col("bucket"))
        near = lambda rows: rows.withColumn("ask_bucket", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))
        n_ask = blocks(members.filter("outside"), "ask_blocks").withColumnRenamed("bucket", "ask_bucket")
        n_own = blocks(members, "own_blocks")
        grid = near(n_own).join(n_ask, ["list", "ask_bucket"])
        salt = lambda count: F.pmod(F.xxhash64("class"), count).cast("int")
        numbers = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        place = ["list", "ask_bucket", "bucket", "ask_block", "own_block"]
        asks = (asked.drop("bucket").join(grid, ["list", "ask_bucket"])
                .withColumn("ask_block", salt(F.col("ask_blocks"))).withColumn("own_block", numbers("own_blocks")).withColumn("asks", F.lit(True)))
        owns = (members.join(grid, ["list", "bucket"])
                .withColumn("own_block", salt(F.col("own_blocks"))).withColumn("ask_block", numbers("ask_blocks")).withColumn("asks", F.lit(False)))
        rows = asks.select(*place, "asks", "class", "root").unionByName(owns.select(*place, "asks", "class", "root"))
        if members.isEmpty():
            return docs.sparkSession.createDataFrame([], "a long, b long")
        texts = staged(self._texts(docs, members.select("class")), "texts")

        def compare(table: pa.Table) -> pa.Table:
            names, asks_, root = (table.column(c).to_pylist() for c in ("class", "asks", "root"))
            own = dict(zip(names, table.column("text").to_pylist()))
            order = list(own)
            sets = dict(zip(order, (s for x, y in portions([own[c] for c in order], 1 << 20) for s in sets_of([own[c] for c in order[x:y]], n))))
            of = dict(zip(names, root))
            left = [c for c, a in zip(names, asks_) if a]
            right = [c for c, a in zip(names, asks_) if not a]
            out = _block_links(left, right, sets, of, share) if left and right else []
            return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        return rows.join(texts, "class").groupBy(*place).applyInArrow(compare, "a long, b long")


def _prefix(own: np.ndarray, frequent: np.ndarray, share: int) -> tuple:
    """(class, size, rare members of the prefix, frequent members of the prefix)."""
    if not len(own):
        return None, 0, own, own
    length = _of_share(len(own), share)
    if not len(frequent):
        return _class(own), len(own), own[:length], own[:0]
    half = (own >> np.uint64(32)).astype(np.uint32)
    common = _is_in(half, frequent)
    rare = own[~common][:length]
    return _class(own), len(own), rare, own[common][:length - len(rare)]


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known``, which is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _may_share(x: np.ndarray, y: np.ndarray, n1: int, n2: int, share: int) -> bool:
    """Whether sets with these prefixes can link: what they share up to the earlier prefix's end is seen, the rest is bounded by size."""
    end = min(x[-1], y[-1])
    x, y = x[:np.searchsorted(x, end, side="right")], y[:np.searchsorted(y, end, side="right")]
    return _links(_shared(x, y) + min(n1 - len(x), n2 - len(y)), n1, n2, share)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def _links(shared: int, n1: int, n2: int, share: int) -> bool:
    return 100 * shared >= share * (n1 + n2 - shared)


def _block_links(left: list[int], right: list[int], sets: dict[int, np.ndarray], root: dict[int, int], share: int) -> list[tuple[int, int]]:
    """For each of ``left`` one link into every component of ``right`` but its own, if there is one."""
    lines = [sets[c] for c in left], [sets[c] for c in right]
    members = np.unique(np.concatenate([s for side in lines for s in side]))
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(members), COLUMNS):
        part = members[start:start + COLUMNS]
        sides = []
        for side in lines:
            table = np.zeros((len(side), len(part)), np.float32)
            for row, own in zip(table, side):
                some = own[np.searchsorted(own, part[0]):np.searchsorted(own, part[-1], side="right")]
                row[np.searchsorted(part, some)] = 1
            sides.append(table)
        shared += sides[0] @ sides[1].T
    n1, n2 = (np.array([len(s) for s in side]) for side in lines)
    exact = shared.astype(np.int64)
    hit = 100 * exact >= share * (n1[:, None] + n2[None, :] - exact)
    out = {}
    for i, j in zip(*np.nonzero(hit)):
        if root[left[i]] != root[right[j]]:
            out.setdefault((left[i], root[right[j]]), (left[i], right[j]))
    return list(out.values())
