"""Near duplicates by an exact Jaccard join of word shingles, with rare-first prefix filtering.

1. One pass gives each document's set digest and adds up, over the whole corpus, how often the shingles of each of
   2**18 hash buckets occur. The order (bucket's count, hash) is one total order for all documents, rare shingles first.
2. A second pass emits each set's prefix under that order: two sets of the wanted similarity share a prefix shingle.
   Sets that are equal are joined by their digest first, and only one document of each goes on.
3. Documents that share a prefix shingle are candidates if the length filter and the positional filter (what two sets
   can share from the shingle's places on) allow it; a suffix filter compares how many shingles the two
   sets have in each of 128 hash ranges (counts up to 255), whose differences bound the overlap from above.
4. Each candidate pair is verified once, on the whole sets. Groups are never expanded into all their pairs: first each
   document meets the smallest document of its prefix shingles; after that, in turns with fresh leaders, only
   documents whose components still differ meet; at last all remaining pairs across components do. A pair that is
   skipped lies within one component already, so the components are final.
5. Linked documents share a component, so all links are counted within components: every two different sets of a
   component are compared whole, in blocks of about BLOCK sets, and only the blocks' counts for each document leave
   their task. A partner counts with all its exact copies.

No join sends the rows of one key to one task: a leader, or a document, with more than a 1024th of all pairs is dealt to
copies of its row. Shingles are told apart by 64-bit hashes that aren't polynomials: of two sets of a million shingles, two
different ones would count as equal with a chance of one in twenty million. Defined results: null texts and texts without
words have an empty set, link with nothing and are their own component; a text of fewer words than a shingle is one
shingle; rows with equal doc_id count as one document, whose links are those of the text with the smallest xxhash64 if the
texts differ (n_shingles is each row's own); documents with null doc_id link with nothing; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, frequent, map_arrow, ngram_hashes, rows_of, sets_of, skewed_join, slices, SMALL, small, stored, texts, words_of
from .graph import components

BUCKETS, CHUNK, RANGES, SLOTS = 1 << 18, 1 << 12, 128, 1 << 26
#: Sets of a component that are compared with one another block in one task; and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 18
_FIRST = "doc_id long, copy long, n long, d1 long, d2 long, ranges binary, chunk int, part long, counts binary"


def _sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    w, n = words_of(texts(column))
    return sets_of(*ngram_hashes(w, n, words))


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _first_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        counts = np.zeros(BUCKETS, np.int64)
        names = [c.split()[0] for c in _FIRST.split(", ")]
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                h, n = _sets(batch.column(1).slice(lo, hi - lo), words)
                counts += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
                d1 = _sum_by(h * (h | np.uint64(1)), n)
                d2 = _sum_by((h ^ (h >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407) ^ h >> np.uint64(7), n)
                k = hi - lo
                row = np.repeat(np.arange(k), n)
                spread = np.minimum(np.bincount(row * RANGES + (h >> np.uint64(57)).astype(np.int64), minlength=k * RANGES), 255).astype(np.uint8).reshape(k, RANGES)
                ranges = pa.array([r.tobytes() for r in spread], pa.binary())
                nothing = pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k), batch.column(2).slice(lo, k), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), ranges, *nothing], names=names)
        if counts.any():
            blobs = counts.reshape(-1, CHUNK)
            k = len(blobs)
            none = [*[pa.nulls(k, pa.int64())] * 5, pa.nulls(k, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int64()), pa.array([b.astype("<u8").tobytes() for b in blobs])], names=names)

    return run


def _bucket_counts(first: DataFrame) -> np.ndarray:
    """The corpus's counts by hash bucket: 2**18 numbers whatever the input, summed over 256 partitions at a time."""

    def add(key, table):
        total = np.zeros(CHUNK, np.uint64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(blob, "<u8")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    blobs = first.filter("chunk is not null").select("chunk", F.expr("part div 256").alias("some"), "counts")
    some = blobs.groupBy("chunk", "some").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(BUCKETS, np.uint64)
    for r in some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<u8")
    return out


def _prefixes(order: np.ndarray, words: int, percent: int):
    """order: each bucket's place by count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(batch.column(1)):
                h, n = _sets(batch.column(1).slice(lo, hi - lo), words)
                row = np.repeat(np.arange(hi - lo), n)
                at = np.lexsort((h, order[(h >> np.uint64(46)).astype(np.int64)], row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                size = np.repeat(n, n)
                keep = place < size - (percent * size + 99) // 100 + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at][keep].view(np.int64)), pa.array(ids[lo:hi][row[keep]], pa.int64()), pa.array(size[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))],
                    names=["token", "doc_id", "n", "place"],
                )

    return run


def _set_rows(words: int, needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((needed.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for lo, hi in slices(batch.column(1)):
                h, n = _sets(batch.column(1).slice(lo, hi - lo), words)
                flat, to = h.tobytes(), (np.cumsum(n) * 8).tolist()
                sets = [flat[b - 8 * k : b] for b, k in zip(to, n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return run


def _suffix_filter(percent: int):
    """Rows (a, b, n_a, n_b, ranges_a, ranges_b) to the pairs (a, b) that may be similar: what the counts of a hash range
    differ by can't be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int32) for k in (4, 5))
            share = (n - np.abs(x - y).sum(1)) // 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(100 * share >= percent * (n - share)))

    return run


def _verify(percent: int):
    """Rows (a, b, set_a, set_b) to linked pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.sort(np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _incidence(code: np.ndarray, row: np.ndarray, rows: int, lo: int, hi: int) -> np.ndarray:
    """Which of the shingles lo ... hi - 1 each set has. ``code``: ascending."""
    at = slice(*np.searchsorted(code, (lo, hi)))
    out = np.zeros((rows, hi - lo), np.float32)
    out[row[at], code[at] - lo] = 1
    return out


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``."""
    flat = [np.concatenate(s) for s in (x, y)]
    both = np.intersect1d(*(np.unique(f) for f in flat), assume_unique=True)
    parts = []
    for sets, f in zip((x, y), flat, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        code = np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0))
        keep = both[code] == f if len(both) else np.zeros(len(f), bool)
        order = np.argsort(code[keep], kind="stable")
        parts.append((code[keep][order], row[keep][order]))
    out = np.zeros((len(x), len(y)), np.int64)
    step = 1 << 12
    for lo in range(0, len(both), step):
        hi = min(lo + step, len(both))
        a, b = (_incidence(code, row, len(sets), lo, hi) for (code, row), sets in zip(parts, (x, y), strict=True))
        out += (a @ b.T).astype(np.int64)
    return out


def _count_links(percent: int):
    """Two blocks of a component's sets, (doc_id, block, copies, hashes), to each document's linked documents in the other."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        block = table.column("block").to_numpy()
        doc_id, copies = table.column("doc_id").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("hashes")]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ids, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            x, y = [sets[k] for k in left], [sets[k] for k in right]
            same = _shared(x, y)
            size = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])
            linked = 100 * same >= percent * (size - same)
            if i == j:
                np.fill_diagonal(linked, False)
            else:
                ids.append(doc_id[right])
                links.append(linked.T @ copies[left])
            ids.append(doc_id[left])
            links.append(linked @ copies[right])
        return pa.table({"rep": pa.array(np.concatenate(ids), pa.int64()), "links": pa.array(np.concatenate(links), pa.int64())})

    return run


def _possible(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filters of two sets that share a shingle at places p1 and p2.

    Of the first shingle that they share it is true that all else they share comes after it, in both; so a pair that
    is similar enough passes at that shingle, and needn't at others.
    """
    least, most = F.least(n1, n2).cast("long"), F.greatest(n1, n2).cast("long")
    share = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * least >= percent * most) & ((100 + percent) * share.cast("long") >= percent * (least + most))


class JaccardJoin:
    """The join of ``docs`` (doc_id, text); see the module's text. ``percent``: least similarity; ``words``: words of a shingle.

    ``turns``: how often components meet through fresh leaders before all remaining pairs do.
    """

    def __init__(self, docs: DataFrame, percent: int = 90, words: int = 3, turns: int = 2):
        self.percent, self.words, self.turns = percent, words, turns
        self.docs = docs.select("doc_id", "text")
        self.log: dict[str, int] = {}

    def _mixed(self, postings: DataFrame, turn: int | None) -> DataFrame:
        """The postings of tokens whose documents are in several components, with the ``turn``'s leader of each token. The two
        documents of a token that has no more have met in the first turn."""
        lead = F.min(F.struct((F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))).alias("rank"), "doc_id", "n", "place", "comp"))
        by_token = postings.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("df"), *([] if turn is None else [lead.alias("lead")]))
        left = by_token.filter("c0 < c1 AND df > 2" if turn != 0 else "c0 < c1").drop("c0", "c1", "df")
        return postings.join(left, "token")

    def _pairs(self, own: DataFrame, turn: int | None) -> DataFrame:
        """Candidates (a, b), a < b, of documents in different components, of postings that ``_mixed`` gave. ``turn`` None:
        all that remain."""
        if turn is None:
            other = own.select("token", F.col("doc_id").alias("doc2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("comp").alias("comp2"))
            own = own.join(other, "token").filter("doc_id < doc2")
        else:
            own = own.select("*", F.col("lead.doc_id").alias("doc2"), F.col("lead.n").alias("n2"), F.col("lead.place").alias("place2"), F.col("lead.comp").alias("comp2"))
        own = own.filter((F.col("comp") != F.col("comp2")) & _possible(F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), self.percent))
        return own.select(F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b")).distinct()

    def _needed(self, pairs: DataFrame) -> np.ndarray:
        """A bitmap of the hashed ids in ``pairs``: at most 8 MB whatever their number; more ids only let more through."""
        slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)) + 1
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot.alias("slot"))
        maps = ids.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
        out = np.zeros(SLOTS // 8, np.uint8)
        for r in maps:
            part = np.frombuffer(r["bits"], np.uint8)
            out[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(part)] = part
        return out

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(doc_id, hashes): only documents that a pair may name leave the scan, as sets."""
        bits = self.docs.sparkSession.sparkContext.broadcast(self._needed(pairs))
        asked = self.docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"))
        return map_arrow(asked, _set_rows(self.words, bits), "doc_id long, hashes binary").dropDuplicates(["doc_id"])

    def _links(self, pairs: DataFrame, n: int, sets: DataFrame, often: list[tuple[int, int]]) -> DataFrame:
        """The ``n`` pairs that whole sets confirm."""
        full = skewed_join(small(pairs, n), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b")), "b", "a", often if n > SMALL else [])
        full = skewed_join(full, sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a")), "a", "b", often)
        return map_arrow(full.select("a", "b", "set_a", "set_b"), _verify(self.percent), "a long, b long")

    def _degrees(self, comp: DataFrame, rep: DataFrame, sets: DataFrame) -> DataFrame:
        """(rep, links): how many documents of other texts each representative is linked with. ``comp``: the final components;
        ``sets``: the sets of all documents that any pair has named, so of all in a component."""
        member = comp.join(rep.select(F.col("rep").alias("node"), "n", "copies"), "node").select(F.col("node").alias("doc_id"), "component", "n", "copies")
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        several = member.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1")
        member = member.join(several, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        member = member.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        # a set meets every block of its component, its own too; of two blocks the smaller one names the group first
        member = cut(member)
        full = small(member, member.count()).join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        full = full.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "block", "copies", "hashes")
        return full.groupBy("component", "i", "j").applyInArrow(_count_links(self.percent), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))

    def _plausible(self, pairs: DataFrame, n: int, first: DataFrame, often: list[tuple[int, int]]) -> DataFrame:
        one = first.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("ranges").alias("ranges_a"))
        two = first.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("ranges").alias("ranges_b"))
        if n <= SMALL:
            often = []
        full = skewed_join(small(skewed_join(small(pairs, n), one, "a", "b", often), n), two, "b", "a", often).select("a", "b", "n_a", "n_b", "ranges_a", "ranges_b")
        return map_arrow(full, _suffix_filter(self.percent), "a long, b long")

    def run(self, count_links: bool = True) -> DataFrame:
        """(doc_id, n_shingles, component_id, n_links): links are all other documents whose sets are similar enough.
        ``count_links``: whether they are counted; else the components alone are found, without the column."""
        first = stored(map_arrow(self.docs.withColumn("copy", F.xxhash64("text")), _first_pass(self.words), _FIRST), "jaccard-first")
        digests = first.filter("chunk is null and doc_id is not null").select("doc_id", "copy", "n", "d1", "d2", "ranges")
        versions = cut(digests.groupBy("doc_id").agg(F.min("copy").alias("least"), F.max("copy").alias("most")).filter("least < most").select("doc_id", "least"))
        if not versions.isEmpty():  # of several texts with one doc_id one links
            chosen = F.coalesce(F.col("least") == F.col("copy"), F.lit(True))
            digests = digests.join(versions, "doc_id", "left").filter(chosen).drop("least")
            self.docs = self.docs.withColumn("copy", F.xxhash64("text")).join(versions, "doc_id", "left").filter(chosen).select("doc_id", "text")
        digests = digests.drop("copy")
        counts = _bucket_counts(first)
        order = np.empty(BUCKETS, np.int32)
        order[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
        rep = digests.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
        postings = map_arrow(self.docs.filter("doc_id is not null"), _prefixes(order, self.words, self.percent), "token long, doc_id long, n int, place int")
        postings = stored(postings, "jaccard-prefixes")

        def several(rows: DataFrame) -> DataFrame:
            return rows.join(rows.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1").select("token"), "token", "left_semi")

        reps = rep.select(F.col("rep").alias("doc_id"))
        shared = several(postings).join(reps, "doc_id", "left_semi").groupBy("token", "doc_id").agg(F.first("n").alias("n"), F.min("place").alias("place"))
        shared = stored(several(cut(shared)), "jaccard-postings")
        dropped(postings)
        profiles = digests.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        comp = links = tested = sets = None
        state = shared.withColumn("comp", F.col("doc_id"))
        for turn in [*range(self.turns), None]:
            if comp is not None:  # components only grow, so tokens within one are done with for good
                named = state.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
                state = named.select("token", "doc_id", "n", "place", F.coalesce("component", "comp").alias("comp"))
            own = self._mixed(state, turn)
            if turn != 0:
                own = cut(own)
                state = own.select("token", "doc_id", "n", "place", "comp")
            pairs = self._pairs(own, turn)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = cut(pairs)
            n = pairs.count()
            often = frequent(pairs.select(F.explode(F.array("a", "b")).alias("id")), n)
            pairs = cut(self._plausible(pairs, n, profiles, often))
            tested = pairs if tested is None else tested.unionByName(pairs)
            n = pairs.count()
            self.log[f"pairs {turn}"] = n
            if n:
                asked = cut(self._sets_of(pairs))
                # a document's set stands once among all turns' sets
                sets = asked if sets is None else sets.unionByName(asked.join(sets.select("doc_id"), "doc_id", "left_anti"))
                found = cut(self._links(pairs, n, asked, often))
                links = found if links is None else links.unionByName(found)
                self.log[f"links {turn}"] = k = found.count()
                if k:
                    comp = cut(components(links))
        if comp is None:
            comp = rows_of(digests.sparkSession, [], pa.schema({"node": pa.int64(), "component": pa.int64()}))
        if links is None or not count_links:
            degree = rows_of(digests.sparkSession, [], pa.schema({"rep": pa.int64(), "links": pa.int64()}))
        else:
            degree = cut(self._degrees(comp, rep, sets))
        dropped(shared)  # what follows reads checkpoints only
        # every document through its set's representative; n_links counts the partners' copies and the own ones
        group = rep.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
        group = group.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        out = first.filter("chunk is null").select("doc_id", "copy", "n", "d1", "d2")
        if not versions.isEmpty():  # all rows of a document share the links of the one text
            own = digests.select("doc_id", F.col("n").alias("own_n"), F.col("d1").alias("own_d1"), F.col("d2").alias("own_d2")).dropDuplicates(["doc_id"])
            group = own.join(group.withColumnsRenamed({"n": "own_n", "d1": "own_d1", "d2": "own_d2"}), ["own_n", "own_d1", "own_d2"]).select("doc_id", "component", "n_links")
            out = out.join(group, "doc_id", "left")
        else:
            often = frequent(digests.filter("n > 0").select(F.col("d1").alias("id")), digests.count())
            out = skewed_join(out, group, "d1", "doc_id", often, "left", ("n", "d2"))
        named = F.col("doc_id").isNotNull()
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("component", "doc_id")).alias("component_id"), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))
        return out if count_links else out.drop("n_links")


def near_duplicates(docs: DataFrame, percent: int = 90, words: int = 3, turns: int = 2, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id its links reach) and n_links."""
    return JaccardJoin(docs, percent, words, turns).run(count_links)
