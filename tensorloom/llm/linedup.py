"""Line dedup: documents that share lines are aligned; aligned common blocks go from the later one.

A block is a run of consecutive lines of WORDS words or more that begins and
ends with lines that are not blank. Every line of a document goes that lies in
a block which some document of smaller id holds as well; this is judged on the
input, over all pairs.

1. Lines are hashed (white space at their ends aside). A block is made of
   shortest runs of WORDS words, so these are what documents are met by: each
   run that several documents hold has an owner, the holder of least id.
   Rarity keeps pairs few in this method; owners do so for runs of any
   frequency: n holders make n pairs, not n * n.
2. A document is paired with the owners of its runs. Of the two only the lines
   of shared runs move, so a document that borrows from many costs no more
   than its own lines.
3. Patience diff aligns the later document's lines with the owner's: those
   that both have once are matched along a longest increasing run, and matches
   spread to equal neighbours. Runs that match line by line as a whole are
   deleted from the later document; runs that only met by their hash match
   nothing. What the diff must leave, as it crosses a match or stands there
   once more, is parted into chains that run in order in both documents; each
   is aligned again, then each run that is still left by itself. As equal runs
   are thus taken whoever holds them, owners stand for all earlier documents.

Cases: null text counts as empty. Blank lines neither pair nor anchor; between
lines of a block they go with it. Documents of equal id are not later than
each other; one without id is neither later nor earlier than any. Repeated
rows stay, each with its own deletions. Other columns stay as they are.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import column, cut, hot_join, slices

#: Words that a common block has at least.
WORDS = 5

#: Names of helper columns, which tables should not have.
KEY, GONE = "__line_key__", "__lines_gone__"


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by the first, whose seconds increase."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        before[k] = last[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both. 0 stands for blank lines, which anchor nothing."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        once: dict[int, int] = {}
        for k in range(j, q):
            once[b[k]] = -1 if b[k] in once else k
        mine: dict[int, int] = {}
        for k in range(i, p):
            mine[a[k]] = -1 if a[k] in mine else k
        anchors = _increasing([(k, once[h]) for h, k in mine.items() if h and k >= 0 and once.get(h, -1) >= 0])
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (p, q)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in pairwise(ends) if x + 1 < u and y + 1 < v]
    return sorted(out)


def run_hash(lines: bytes) -> bytes:
    """What documents meet by."""
    return xxh3_128_digest(lines)


def runs(lines: list[int], words: list[int], least: int = WORDS) -> dict[bytes, list[tuple[int, int]]]:
    """First and last positions of the shortest runs of so many words, by hash.

    They are those that no line more at an end is needed for, from each line
    on and up to each line, and two lines about blank ones. Any position of
    a block of ``least`` words lies in one within that block.
    """
    at = [i for i, h in enumerate(lines) if h]
    found = set()
    a = total = 0
    for z, i in enumerate(at):  # up to z
        total += words[i]
        while total - words[at[a]] >= least:
            total -= words[at[a]]
            a += 1
        if total >= least:
            found.add((at[a], i))
    z, total = len(at) - 1, 0
    for a in range(len(at) - 1, -1, -1):  # from a on
        total += words[at[a]]
        while total - words[at[z]] >= least:
            total -= words[at[z]]
            z -= 1
        if total >= least:
            found.add((at[a], at[z]))
    found.update((i, j) for i, j in pairwise(at) if j > i + 1 and words[i] + words[j] >= least)
    data = array("q", lines).tobytes()
    out: dict[bytes, list[tuple[int, int]]] = {}
    for i, j in sorted(found):
        out.setdefault(run_hash(data[8 * i : 8 * j + 8]), []).append((i, j))
    return out


def _sequence(lines: dict[int, int], free: int) -> tuple[list[int], list[int]]:
    """Positions in order and what they hold, with something unequal to all (``free`` and on) where one is left out."""
    places, held = [], []
    for p in sorted(lines):
        if places and p > places[-1] + 1:
            places.append(-1)
            held.append(free + len(held))
        places.append(p)
        held.append(lines[p])
    return places, held


#: Where a run begins in the later and in the earlier document, and the lines of either there.
Shared = tuple[int, int, list[int], list[int]]


def _pass(left: list[Shared]) -> set[tuple[int, int]]:
    """Places (later, earlier) that a patience diff over the lines of some run occurrences matches."""
    mine, other = {}, {}
    for i, at, held, theirs in left:
        mine.update(zip(range(i, i + len(held)), held, strict=True))
        other.update(zip(range(at, at + len(theirs)), theirs, strict=True))
    # Line hashes are signed 64-bit numbers; fillers lie beyond them, apart for either side.
    (a, x), (b, y) = _sequence(mine, 1 << 64), _sequence(other, 1 << 65)
    return {(a[i], b[j]) for i, j in patience(x, y)}


def _chains(left: list[Shared]) -> list[list[Shared]]:
    """Run occurrences parted so that each part goes down both documents: every next one lies behind the last in both, or on its diagonal."""
    ends: list[tuple[int, int]] = []  # of each open chain: where it ends in the earlier document, and its number
    out: list[list[Shared]] = []
    for one in sorted(left, key=lambda x: (x[0], x[1])):
        i, at, held, theirs = one
        p = bisect_left(ends, (at + len(theirs), -1)) - 1
        while p >= 0:
            j, there, mine, other = out[ends[p][1]][-1]
            if i - j == at - there or (i >= j + len(mine) and at >= there + len(other)):
                break
            p = p - 1 if ends[p][0] > at else -1
        if p >= 0:
            k = ends.pop(p)[1]
            out[k].append(one)
        else:
            k = len(out)
            out.append([one])
        end = (at + len(theirs), k)
        ends.insert(bisect_left(ends, end), end)
    return out


def aligned(shared: list[tuple[list[int], int, list[int], list[int]]]) -> set[int]:
    """Lines of the later document in blocks aligned with the earlier one.

    ``shared``: of each run by which both met, where it begins in the later
    document, where it first begins in the earlier one, and the lines of each.
    """
    gone: set[int] = set()
    left: list[Shared] = [(i, at, held, theirs) for begins, at, held, theirs in shared for i in begins]
    for parted in (lambda x: [x], _chains, lambda x: [[one] for one in x]):
        stay = []
        for part in parted(left):
            matched = _pass(part)
            for one in part:
                i, at, held, theirs = one
                if len(held) == len(theirs) and all((i + k, at + k) in matched for k in range(len(held))):
                    gone.update(range(i, i + len(held)))
                else:
                    stay.append(one)
        left = [x for x in stay if not gone.issuperset(range(x[0], x[0] + len(x[2])))]
        if not left:
            break
    return gone


def _runs_of(batches):
    for batch in slices(batches, "text"):
        rows = []
        for d, k, text in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "key")), column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
            lines = [x.strip() for x in (text or b"").split(b"\n")]
            # Signed longs; a blank line is 0.
            hashes = [xxh64_intdigest(x) - (1 << 63) if x else 0 for x in lines]
            for run, places in runs(hashes, [len(x.split()) for x in lines]).items():
                i, j = places[0]
                rows.append((d, k, run, [p for p, _ in places], hashes[i : j + 1]))
        if rows:
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["doc_id", "key", "run", "begins", "held"])


def _gone(batches):
    for batch in batches:
        gone = []
        for shared in column(batch, "shared").to_pylist():
            out: set[int] = set()
            for _, of in groupby(sorted(shared, key=lambda x: (x["owner"], x["at"], x["begins"])), key=lambda x: x["owner"]):
                out |= aligned([(x["begins"], x["at"], x["held"], x["theirs"]) for x in of])
            gone.append(sorted(out))
        yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])


def deletions(own: DataFrame) -> DataFrame:
    """key and gone: positions of the lines to delete. ``own``: doc_id, key, text."""
    found = cut(own.filter("doc_id IS NOT NULL").mapInArrow(_runs_of, "doc_id long, key binary, run binary, begins array<int>, held array<long>"), "runs")
    first = F.min(F.struct("doc_id", "key", F.col("begins")[0].alias("at"), "held"))
    owned = cut(found.groupBy("run").agg(F.count("*").alias("df"), first.alias("owner")).filter("df > 1"), "owned")
    total = owned.agg(F.sum("df")).first()[0] or 0
    shared = hot_join(found, owned, "run", "df", total).filter("owner.doc_id < doc_id")
    # A set, so that a row repeated very often brings its runs once.
    pairs = shared.select("key", F.struct(F.col("owner.key").alias("owner"), F.col("owner.at").alias("at"), F.col("owner.held").alias("theirs"), "begins", "held").alias("one"))
    return pairs.groupBy("key").agg(F.collect_set("one").alias("shared")).mapInArrow(_gone, "key binary, gone array<int>")


def _applied(names: list[str], counts: bool):
    at = names.index("text")

    def run(batches):
        for batch in slices(batches, "text"):
            texts, gone = batch.column(at).to_pylist(), column(batch, GONE).to_pylist()
            n_lines = [len(t.split("\n")) if t else 0 for t in texts]
            for i, g in enumerate(gone):
                if g:
                    out = set(g)
                    texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in out])
            arrays = batch.columns[: len(names)]
            if "n_chars" in names:
                k = names.index("n_chars")
                sizes = [len(t) if g else n for t, g, n in zip(texts, gone, arrays[k].to_pylist(), strict=True)]
                arrays[k] = pa.array(sizes, batch.schema.field(k).type)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if counts:
                arrays += [pa.array(n_lines, pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *["n_lines", "n_deleted"] * counts])

    return run


def _row_key() -> Column:
    """Tells rows of other id or text apart; null without id."""
    return F.unhex(F.md5(F.concat_ws(" ", F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))))


def _apply(docs: DataFrame, counts: bool) -> DataFrame:
    key = F.when(F.col("doc_id").isNotNull(), _row_key())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    gone = cut(deletions(own), "gone").select(F.col("key").alias(KEY), F.col("gone").alias(GONE))
    # One plan at every size: what is deleted grows with the documents.
    full = docs.withColumn(KEY, key).join(gone.hint("merge"), KEY, "left").select(*docs.columns, GONE)
    more = [T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())] if counts else []
    return full.mapInArrow(_applied(docs.columns, counts), T.StructType([*docs.schema.fields, *more]))


def remove_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_lines (of the input) and n_deleted of each document."""
    return _apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), True)


def clean(docs: DataFrame) -> DataFrame:
    """The documents with aligned blocks deleted; their columns stay, n_chars follows the text."""
    return _apply(docs, False)
