"""Line deduplication by pairwise alignment.

Documents that overlap are found through hashes of their lines: a line of ``min_words`` words or more is a key by itself;
a shorter one is keyed with the lines after it, or before it, as far as they are needed to have so many words together
(lines without words don't count). Such a passage is at most as frequent as the rarest of its lines. Every aligned block
that is long enough to be deleted is made of such passages: each of its lines is in one that lies within the block. So
the earliest holder of each passage is all that the later ones have to meet: a line lies in a block that is shared with
any earlier document exactly if one of its passages has an earlier holder. Pairs are linear in the lines, however large a
group of copies is, with no limit on how frequent a line may be.

Each later document is aligned with each of those earlier ones by patience diff over the lines that their shared passages
cover: equal lines at both ends, then the lines that are unique in both, in their longest increasing order, and again
between them. Aligned runs of ``min_words`` words or more are blocks. Passages that the diff leaves over, as they cross
the others' order or are repeated, are aligned again by themselves. Blocks are deleted from the later document (the
larger doc_id). The earliest holder of a line never loses it, so every line stays somewhere.

Lines are compared without the white space around them, by 128-bit digests (BLAKE2). A passage that a third of all
documents share is no hot key: at most HOT passages can have a HOT-th of all rows each, and those are looked up by
broadcast. Defined results: null texts count as empty and stay null; lines without words are never deleted; rows with equal
doc_id and equal text lose the same lines, and rows with equal doc_id are no pair; rows with a null doc_id are left alone;
other columns pass through whatever their names, those named like a result are replaced; an empty table gives an empty
table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, map_arrow, slices, stored, texts

#: Passages with more than this share (one in HOT) of all rows are looked up by broadcast: there can't be more than HOT.
HOT = 1024
_LINES = "doc_id long, copy long, tokens array<long>, words array<int>, places array<int>, keys array<struct<k1:long,k2:long,at:array<int>,n:int>>"
BLOCKS = "doc_id long, copy long, early long, early_line int, line int, n int"


def passages(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(from, to) of the shortest runs of lines that begin, or end, at each line and have ``min_words`` words."""
    out: dict[tuple[int, int], None] = {}
    upto, total = 0, 0
    for k, n in enumerate(words):  # from line k on
        while upto < len(words) and total < min_words:
            total += words[upto]
            upto += 1
        if total < min_words:
            break
        out[k, upto] = None
        total -= n
    lo, total = 0, 0
    for k, n in enumerate(words):  # up to line k
        total += n
        while total - words[lo] >= min_words:
            total -= words[lo]
            lo += 1
        if total >= min_words:
            out[lo, k + 1] = None
    return list(out)


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                tokens, words, places, ends = [], [], [], [0]
                key_ends, runs, run_ends, sizes, digests = [0], [], [0], [], []
                for text in texts(batch.column(1).slice(lo, hi - lo)):
                    own, counts = [], []
                    for k, line in enumerate(text.split(b"\n")):
                        if line := line.strip():
                            own.append(blake2b(line, digest_size=16).digest())
                            counts.append(len(line.split()))
                            places.append(k)
                    found: defaultdict[tuple[bytes, int], list[int]] = defaultdict(list)
                    for a, b in passages(counts, min_words):
                        found[own[a] if b == a + 1 else blake2b(b"".join(own[a:b]), digest_size=16).digest(), b - a].append(a)
                    for (digest, n), at in found.items():
                        digests.append(digest)
                        sizes.append(n)
                        runs += sorted(at)
                        run_ends.append(len(runs))
                    tokens += own
                    words += counts
                    ends.append(len(tokens))
                    key_ends.append(len(sizes))
                offsets, key_offsets = pa.array(ends, pa.int32()), pa.array(key_ends, pa.int32())
                k = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                keys = pa.StructArray.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.ListArray.from_arrays(pa.array(run_ends, pa.int32()), pa.array(runs, pa.int32())), pa.array(sizes, pa.int32())], ["k1", "k2", "at", "n"])
                first = np.frombuffer(b"".join(tokens), "<i8").reshape(-1, 2)[:, 0].copy()  # tells the lines of two documents apart for the diff
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((first, pa.int64()), (words, pa.int32()), (places, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists, pa.ListArray.from_arrays(key_offsets, keys)], names=["doc_id", "copy", "tokens", "words", "places", "keys"])

    return run


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j), ascending in both, of equal items a[i], b[j]; 0 is equal to nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            if a[a0]:
                out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            if a[a1]:
                out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        there: dict[int, int] = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        both = [(once[x], j) for x, j in there.items() if x and j >= 0 and once.get(x, -1) >= 0]  # ascending in j
        if not both:
            continue
        tops: list[int] = []
        last: list[int] = []
        back = [-1] * len(both)
        for k, (i, _) in enumerate(both):
            p = bisect_left(tops, i)
            back[k] = last[p - 1] if p else -1
            if p == len(tops):
                tops.append(i)
                last.append(k)
            else:
                tops[p], last[p] = i, k
        k, chain = last[-1], []
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        x, y = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, a1, y, b1))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(i, j, n): aligned runs of n lines, from line i of the earlier and line j of the later document, with enough words."""
    out: list[tuple[int, int, int]] = []
    begin, size, at = (0, 0), 0, (-9, -9)
    for i, j in [*pairs, (-1, -1)]:
        if (i, j) != (at[0] + 1, at[1] + 1):
            if size >= min_words:
                out.append((*begin, at[1] + 1 - begin[1]))
            begin, size = (i, j), 0
        if j >= 0:
            size += words[j]
        at = (i, j)
    return out


def align(tokens: list[int], words: list[int], shared: list[dict], min_words: int) -> list[tuple[int, int, int, int]]:
    """(early, i, j, n): the aligned blocks of one later document. ``shared``: its passages with their earliest holders,
    (early, first: the line there, at: the lines here, n)."""
    out = []
    by_early = defaultdict(list)
    for x in shared:
        by_early[x["early"]].append((x["first"], x["at"], x["n"]))
    for early in sorted(by_early):
        there: dict[int, int] = {}
        here: set[int] = set()
        for first, at, n in by_early[early]:
            there.update(zip(range(first, first + n), tokens[at[0] : at[0] + n], strict=True))
            for j in at:
                here.update(range(j, j + n))
        a, b = sorted(there), sorted(here)
        found = blocks([(a[i], b[j]) for i, j in patience([there[i] for i in a], [tokens[j] for j in b])], words, min_words)
        gone = {k for _, j, n in found for k in range(j, j + n)}
        left = sorted((j, first, n) for first, at, n in by_early[early] for j in at if not gone.issuperset(range(j, j + n)))
        out += [(early, i, j, n) for i, j, n in found] + [(early, first, j, n) for j, first, n in left]
    return out


def _align(min_words: int):
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, copy, tokens, words, shared = (batch.column(c)[k].as_py() for c in range(5))
                rows = [(doc_id, copy, *x) for x in align(tokens, words, shared, min_words)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _shared(lines: DataFrame) -> DataFrame:
    """(doc_id, copy, early, first, at, n): passages of documents with their earliest holders, where those are earlier."""
    rows = lines.select("doc_id", "copy", F.explode("keys").alias("key")).select("doc_id", "copy", "key.*")
    owners = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("early"), F.min_by(F.get("at", F.lit(0)), "doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
    owners = cut(owners.filter("early < last").drop("last"))
    total = lines.agg(F.sum(F.size("keys"))).collect()[0][0] or 0
    hot = F.col("holders") > total / HOT
    often = F.broadcast(owners.filter(hot).select("k1", "k2", "early", "first"))  # fewer than HOT rows, by the count above
    marked = rows.join(often, ["k1", "k2"], "left")
    rest = marked.filter("early IS NULL").drop("early", "first").join(owners.filter(~hot).select("k1", "k2", "early", "first"), ["k1", "k2"])
    found = marked.filter("early IS NOT NULL").unionByName(rest).filter("early < doc_id")
    return found.select("doc_id", "copy", F.struct("early", "first", "at", "n").alias("shared"))


def _blocks(lines: DataFrame, min_words: int) -> DataFrame:
    shared = _shared(lines).groupBy("doc_id", "copy").agg(F.collect_set("shared").alias("shared"))  # at most the document's own passages
    full = lines.select("doc_id", "copy", "tokens", "words").join(shared, ["doc_id", "copy"])
    return map_arrow(full.select("doc_id", "copy", "tokens", "words", "shared"), _align(min_words), BLOCKS)


def _prepared(docs: DataFrame, min_words: int) -> DataFrame:
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return stored(map_arrow(rows, _lines(min_words), _LINES).filter(F.size("keys") > 0), "line-keys")


def alignments(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(doc_id, copy, early, early_line, line, n): the aligned blocks, from line ``line`` of the later and ``early_line`` of
    the earlier document, both counted from 0 among the lines with words. ``copy``: xxhash64 of the text."""
    return _blocks(_prepared(docs, min_words), min_words).distinct()


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, left, n_lines, n_removed): the input row as a struct and what is left of its text."""
    lines = _prepared(docs, min_words)
    spans = _blocks(lines, min_words).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("line", "n")).alias("spans"))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["line"], x["line"] + x["n"] - 1)))))
    gone = spans.join(lines.select("doc_id", "copy", "places"), ["doc_id", "copy"]).select("doc_id", "copy", F.transform(numbers, lambda k: F.get("places", k)).alias("gone"))
    gone = cut(gone.dropDuplicates(["doc_id", "copy"]))
    dropped(lines)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("copy"))
    marked = rows.join(gone, ["doc_id", "copy"], "left")
    split = F.split("text", "\n")
    # The deleted lines stand in ascending order: what stays are the stretches between them. The lines are a variable of the
    # outer function, as Spark works out again for each element whatever else stands in an inner one.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda k: k + 1))

    def kept(lines):
        return F.array_join(F.flatten(F.zip_with(starts, F.concat("gone", F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(split), kept), F.lit(0)))
    n_lines = F.when(F.length("text") > 0, F.size(split)).otherwise(0).cast("long")
    return marked.select("row", left.alias("left"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with the deleted lines taken out of text, and the columns n_lines, n_removed (long)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _marked(docs, min_words).select(*[F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], "n_lines", "n_removed")


def keep_rest(docs: DataFrame, min_words: int = 20, length: str = "n_chars") -> DataFrame:
    """``docs`` with the deleted lines taken out, without the documents of which no word is left; a column ``length``, if there
    is one, follows the text where it has changed. All columns of ``docs`` and no others."""
    out = _marked(docs, min_words).filter((F.col("n_removed") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))

    def column(name: str):
        old = F.col("row")[name]
        if name == "text":
            old = F.col("left")
        elif name == length:
            old = F.when(F.col("n_removed") > 0, F.length("left").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return out.select(*map(column, docs.columns))


#: What is left of each document, in DuckDB: passages are lists of lines, and a line goes if one of its passages has an earlier holder.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM t),
s AS (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(line, '[^ 	-
]+')) AS words FROM u),
k AS (SELECT doc_id, pos, line, words, row_number() OVER w AS k, sum(words) OVER w AS upto FROM s WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l AS (SELECT doc_id, list(line ORDER BY k) AS lines FROM k GROUP BY doc_id),
p AS (SELECT a.doc_id, a.k AS lo, min(b.k) AS hi FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 19 AND b.upto - a.upto + a.words >= 20 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.k), b.k FROM k b JOIN k a ON a.doc_id = b.doc_id AND a.k BETWEEN b.k - 19 AND b.k AND b.upto - a.upto + a.words >= 20 GROUP BY b.doc_id, b.k),
g AS (SELECT p.doc_id, lo, hi, list_slice(lines, lo, hi) AS passage FROM p JOIN l USING (doc_id)),
o AS (SELECT passage, min(doc_id) AS early FROM g GROUP BY passage HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS k FROM g JOIN o USING (passage) WHERE early < doc_id),
r AS (SELECT k.doc_id, k.pos FROM k JOIN x USING (doc_id, k)),
n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id),
c AS (SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.pos) AS rest FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.pos = r.pos GROUP BY u.doc_id),
f AS (SELECT t.doc_id, CASE WHEN t.text = '' THEN 0 ELSE len(ls) END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(CASE WHEN n_removed IS NULL THEN t.text ELSE rest END, '') AS rest FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, n_removed, CAST(length(rest) AS BIGINT) AS chars_left, sha256(rest) AS text_sha256 FROM f
"""
