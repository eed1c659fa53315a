"""Near-duplicates by order MinHash, verified by banded alignment.

A document is the sequence of its k-mers: runs of ``K`` words, folded to lower case; a text with fewer words is one k-mer of
all of them. Each of ``SKETCHES`` sketches takes the ``ELL`` k-mers, labelled with their number of occurrence, that a random order puts
first, and keeps them in text order, so texts meet in a sketch with a probability that falls with edits and with
reordering. With few k-mers that probability is small and uneven, so texts of at most ``SHORT`` k-mers have sketches of one k-mer
each (and those a little longer have both kinds, so that they meet either). The similarity that decides is that of the best alignment of the
two sequences: aligned k-mers over all k-mers of both less the aligned. It equals the Jaccard similarity of the k-mers where
order is the same. The band of the alignment is widened until it decides, at most to what the threshold lets aligned k-mers drift apart,
so nothing that would pass is missed.

Equal texts are one node (md5 of the text). Two texts are compared, or connected by others that were, if they share ``SHARED``
sketches: pairs of similarity 0.8 fail to once in a million times, whatever the size of their buckets. Texts that share a sketch form a
bucket; its members are verified against its leader, the first of it in one of ``ORDERS`` random orders; links are closed
to components. Members of a bucket that are not in the component of their leader are then compared with all members, also those
that joined it, where they lie; more than ``LIMIT`` members are compared in blocks. If more than ``LIMIT`` are outside, the bucket
is first cut finer by the second of the shared sketches. So no task holds more than about ``LIMIT`` texts of a bucket, and no partner is capped.

Nulls: a null text equals an empty one. Texts without words are alike only if equal. Repeated rows share a class.
A class is named by its smallest doc_id (null if all are null). Empty tables give no rows. Long texts are read whole.
Other columns of any name are ignored. Copies of a text are put together before the shuffle, so a text that a third of all rows
hold is one row of the work; classes of more than ``HOT`` rows are joined back by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, table

K, ELL, SKETCHES, THRESHOLD, ORDERS = 5, 3, 24, 0.8, 12
#: K-mers up to which a text has sketches of one k-mer; to meet a text of so many at THRESHOLD, one can have a quarter more.
SHORT = 32
#: Texts of a bucket that are compared in one task, and sketches two of them share.
LIMIT, SHARED = 1024, 2
#: Rows of a key beyond which it is joined by broadcast: of n rows, at most n / HOT keys.
HOT = 1_000_000
#: Band that an alignment begins with, factor by which it widens, and places in a piece of its bit masks.
BAND, WIDEN, CELL = 64, 8, 2048
#: Members of one leader that are verified in one task's run; a leader with more is spread over several.
SPREAD = 256
CHUNK = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_POW = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | _U(1)
_MIX = [_U(int(x) | 1) for x in _rng.integers(1, 2**63, K)]
_SALT = _rng.integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64) | _U(1)
_MAX = _U(2**64 - 1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII blanks, lower case) of each text."""
    blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(b) + 1 for b in blobs])
    if not len(start):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    inside = np.flatnonzero(~blank)
    size = end - start
    first = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(len(inside)) - np.repeat(first, size)
    h = np.add.reduceat((raw[inside].astype(np.uint64) + _U(1)) * _POW[place & 4095] + (place >> 12).astype(np.uint64), first)
    h = _scramble(h + size.astype(np.uint64))
    return np.split(h, np.searchsorted(start, ends[:-1]))


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of ``k`` words; of all the words, if fewer; none without words."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = h[: n - k + 1] * _MIX[0]
    for i in range(1, k):
        out = out + h[i : n - k + 1 + i] * _MIX[i]
    return _scramble(out + _U(k))


def label(seq: np.ndarray) -> np.ndarray:
    """K-mers mixed with their number of occurrence, so that every position differs."""
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return seq
    at = np.arange(len(s))
    nth = np.empty(len(s), dtype=np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, _scramble(seq + nth * _U(0x9E3779B97F4A7C15)), seq)


def minima(seq: np.ndarray, ell: int) -> np.ndarray:
    """One hash per sketch: the ``ell`` labelled k-mers that come first in its order, as they stand in the text."""
    h = (label(seq)[None, :] ^ _SALT) * _MUL
    h ^= h >> _U(29)
    rows = np.arange(SKETCHES)
    picks = np.empty((SKETCHES, min(ell, len(seq))), dtype=np.int64)
    for j in range(picks.shape[1]):
        picks[:, j] = h.argmin(axis=1)
        h[rows, picks[:, j]] = _MAX
    picks.sort(axis=1)
    chosen = seq[picks]
    out = np.full(SKETCHES, picks.shape[1], dtype=np.uint64)
    for j in range(picks.shape[1]):
        out = _scramble(out * _U(0xD6E8FEB86659FD93) + chosen[:, j])
    return out.astype(np.int64)


def sketch(seq: np.ndarray) -> np.ndarray:
    """The sketches of one k-mer, then those of ELL; 0 for those a text of its length does not have."""
    out = np.zeros(2 * SKETCHES, dtype=np.int64)
    if len(seq) <= SHORT * 5 // 4:
        out[:SKETCHES] = minima(seq, 1)
    if len(seq) > SHORT:
        out[SKETCHES:] = minima(seq, ELL)
    return out


def banded(a: list, b: list, band: int) -> int:
    """Longest common subsequence of matches at most ``band`` places off the diagonal. Bit-parallel: the state of a row is one bit
    for each place of the band, which slides with the row; bits that leave it are final. Time and memory are rows times band."""
    where: dict[int, dict[int, int]] = {x: {} for x in a}
    for j, x in enumerate(b):
        cells = where.get(x)
        if cells is not None:
            cells[j // CELL] = cells.get(j // CELL, 0) | 1 << j % CELL
    width, done, at, end = 2 * band + 1, 0, 0, (len(b) - 1) // CELL
    full = (1 << width) - 1
    v = full
    for i, x in enumerate(a):
        cells = where[x]
        if not cells:
            continue
        step, at = i - at, i
        if step >= width:
            done, v = done + width - v.bit_count(), full
        elif step:
            low = (1 << step) - 1
            done += step - (v & low).bit_count()
            v = v >> step | low << width - step
        first, m = i - band, 0
        for c in range(max(first, 0) // CELL, min((i + band) // CELL, end) + 1):
            got = cells.get(c)
            if got:
                off = c * CELL - first
                m |= got << off if off >= 0 else got >> -off
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & full
    return done + width - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, band: int, enough: int | None = None) -> int:
    """Most k-mers that can be aligned in order, none more than ``band`` places apart; if ``enough`` is given, some number not below it
    where there are as many, else some number below it. Narrower bands are tried first: an alignment that leaves no more k-mers alone than
    its band is wide is the best of all."""
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    head = int(diff[0]) if len(diff) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n == 0:
        return head
    diff = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(diff[0]) if len(diff) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    ends = head + tail
    if not len(a) or not len(b):
        return ends
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[xa], cb[xb]).sum())
    if not common or (enough is not None and ends + common < enough):
        return ends + (0 if enough is None else common)
    if len(ua) == len(a) and len(ub) == len(b):
        pa, pb = ia[xa], ib[xb]
        order = np.argsort(pa)
        pa, pb = pa[order], pb[order]
        if (np.diff(pb) > 0).all() and (np.abs(pa - pb) <= band).all():
            return ends + common
    a, b = a.tolist(), b.tolist()
    now = min(band, BAND)
    while True:
        got = banded(a, b, now)
        if now == band or len(a) + len(b) - 2 * got <= now or (enough is not None and ends + got >= enough):
            return ends + got
        now = min(band, now * WIDEN)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned over all: some number that reaches ``threshold`` if and only if that of the best alignment does."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    # so many k-mers of the pair may stay alone, and so far may aligned ones be apart
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if min(n, m) < need:
        return 0.0
    band = max(n, m) - need
    got = aligned(a, b, band, need)
    return got / (n + m - got)


def _sequences(texts) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and k-mers of each text, hashed some megabyte at a time."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        held.append(t if isinstance(t, str) else "")
        size += len(held[-1])
        if size > CHUNK:
            yield from zip(rows, map(kmers, word_hashes(held)), strict=True)
            rows, held, size = [], [], 0
    if rows:
        yield from zip(rows, map(kmers, word_hashes(held)), strict=True)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [None] * len(pdf)
        for i, seq in _sequences(pdf["text"]):
            out[i] = sketch(seq) if len(seq) else np.zeros(0, dtype=np.int64)
        yield pd.DataFrame({"node": pdf["node"], "sketch": out})


def _verifier(threshold: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, lead_seq = None, None
        for pdf in batches:
            keep = []
            nodes, leads = pdf["node"].tolist(), pdf["lead"].tolist()
            for i, seq in _sequences(pdf["text"]):
                if nodes[i] == leads[i]:  # the leader's own row comes first in its group
                    lead, lead_seq = leads[i], seq
                    continue
                assert leads[i] == lead
                if similarity(lead_seq, seq, threshold) >= threshold:
                    keep.append(i)
            yield pdf.iloc[keep][["lead", "node"]]

    return verify


def nodes_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("node"), text.alias("text"))


def links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the (lead, node) pairs whose texts align to ``threshold``. Leaders with many members are spread over tasks
    by a hash of the member; each part gets the leader's text once, ahead of the members."""
    many = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts"))
    pairs = pairs.join(many, "lead").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    heads = many.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("node"))
    both = heads.unionByName(pairs.select("lead", "part", "node")).join(texts.select("node", "text"), "node")
    both = both.select("lead", "part", (F.col("node") != F.col("lead")).alias("member"), "node", "text")
    ordered = both.repartition("lead", "part").sortWithinPartitions("lead", "part", "member")
    return ordered.drop("part", "member").mapInPandas(_verifier(threshold), "lead binary, node binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for the nodes of ``edges`` (u, v). Alternating large-star and small-star
    steps, each a grouped minimum and a join; every step is written to the shared folder."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the larger end of each edge is u, its smaller neighbours and itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = cut(small)
        # done when every node hangs on one root and no root hangs on another node
        split = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() if not split else 1
        drop(now)
        now = new
        if not chained:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _closer(threshold: float, depth: int):
    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nodes, roots, seqs, uniqs = None, [], [], [], []
        sketches, sizes, sides = np.zeros((64, 2 * SKETCHES), dtype=np.int64), np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int8)
        for pdf in batches:
            out = []
            rows = zip(_sequences(pdf["text"]), pdf["group"], pdf["last"], pdf["side"], pdf["node"], pdf["root"], pdf["sketch"], strict=True)
            for (_, seq), g, last, side, node, own, mine in rows:
                if g != group:
                    group, nodes, roots, seqs, uniqs = g, [], [], [], []
                n, at = len(seq), len(nodes)
                if at == len(sizes):
                    sketches, sizes, sides = (np.concatenate([x, np.zeros_like(x)]) for x in (sketches, sizes, sides))
                # of sides that meet, first met here, alike in SHARED sketches, of fitting length and not connected already
                same = (sketches[:at] == mine) & (mine != 0)
                short, long_ = np.minimum(sizes[:at], n), np.maximum(sizes[:at], n)
                meet = ((sides[:at] == 0) | (sides[:at] != side)) & (same[:, :last].sum(axis=1) == depth)
                near = np.flatnonzero(meet & (same.sum(axis=1) >= SHARED) & (short >= threshold * long_))
                uniq = None
                for i in near.tolist():
                    if roots[i] == own:
                        continue
                    uniq = np.unique(seq) if uniq is None else uniq
                    other = seqs[i]
                    if uniqs[i] is None:
                        uniqs[i] = np.unique(other)
                    need = int(np.ceil(threshold * (n + len(other)) / (1 + threshold) - 1e-9))
                    if len(np.intersect1d(uniq, uniqs[i], assume_unique=True)) + n - len(uniq) < need:
                        continue
                    if similarity(other, seq, threshold) >= threshold:
                        out.append((nodes[i], node))
                        old = roots[i]
                        roots = [own if x == old else x for x in roots]
                nodes.append(node)
                roots.append(own)
                seqs.append(seq)
                uniqs.append(uniq)
                sketches[at], sizes[at], sides[at] = mine, n, side
            yield pd.DataFrame(out, columns=["lead", "node"])

    return close


def blocks(left: DataFrame, limit: int) -> DataFrame:
    """group, last, side, node, root: the members of each bucket laid out so that every two of which one is ``out`` of the leader's
    component meet in a group. A bucket of at most ``limit`` is one group (side 0: all meet all). A larger one is cut by a hash into
    blocks of about ``limit / 2``, and those of the rest meet each other and those of the joined, two in a group (sides 1 and 2)."""
    half = max(1, limit // 2)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("bx")).otherwise(F.col("bj"))).cast("int")
    one = F.col("n") <= limit
    bx = F.when(one, 1).otherwise(F.ceil(F.col("x") / half)).cast("int")
    bj = F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("x")) / half)).cast("int")
    at = left.withColumns({"one": one, "bx": bx, "bj": bj}).withColumn("own", own)
    other = F.when(F.col("one"), F.array(F.lit(0))).when(F.col("out"), F.sequence(F.lit(0), F.col("bx") + F.col("bj") - 1)).otherwise(F.sequence(F.lit(0), F.col("bx") - 1))
    at = at.withColumn("place", F.when(F.col("one"), 0).when(F.col("out"), F.col("own")).otherwise(F.col("bx") + F.col("own"))).withColumn("other", F.explode(other))
    side = F.when(F.col("place") == F.col("other"), 0).when(F.col("place") < F.col("other"), 1).otherwise(2)
    group = F.xxhash64("band", "h", F.least("place", "other"), F.greatest("place", "other"))
    return at.select(group.alias("group"), "last", side.alias("side"), "node", "root")


def closed(left: DataFrame, texts: DataFrame, threshold: float, limit: int, depth: int) -> DataFrame:
    """Links between members of a bucket that are in different components, every two of which are compared where they lie: one
    group is in one task, and only links leave it. Two that share several buckets are compared in the first; ``depth`` sketches
    before ``last`` are shared by all members."""
    rows = blocks(left, limit).join(texts, "node")
    return rows.repartition("group").sortWithinPartitions("group", "node").mapInPandas(_closer(threshold, depth), "lead binary, node binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """node, root of every different text of ``docs`` that has a near-duplicate; all other texts are their own root."""
    nodes, made = nodes_of(docs), []

    def keep(df: DataFrame) -> DataFrame:
        made.append(cut(df))
        return made[-1]

    sketched = cut(nodes.mapInPandas(_sketches, "node binary, sketch array<long>").groupBy("node").agg(F.first("sketch").alias("sketch")))
    band = sketched.select("node", F.posexplode("sketch").alias("band", "h")).where("h <> 0")
    met = band.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bands = keep(band.join(met, ["band", "h"]).select("node", "band", "h"))
    some = sketched.join(bands.select("node").distinct(), "node", "left_semi")
    # copies of a text become one before the shuffle; the join needs no other
    texts = keep(nodes.groupBy("node").agg(F.first("text").alias("text")).join(some, "node"))
    drop(sketched)
    rest = bands.select("node", F.col("node").alias("root"), F.col("band").cast("long").alias("band"), "h", F.col("band").alias("last"))
    rank = F.struct(F.xxhash64("node", F.col("band") % ORDERS).alias("rank"), "node", "root")
    found, root = None, None
    for depth in range(SHARED):
        lead = rest.groupBy("band", "h").agg(F.min(rank).alias("lead")).select("band", "h", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root"))
        led = keep(rest.join(lead, ["band", "h"]).where("node != lead"))
        open_ = led.where("root != lead_root")
        if not open_.limit(1).count():
            break
        new = keep(links(open_.select("lead", "node").distinct(), texts, threshold))
        found = new if found is None else found.unionByName(new)
        root = keep(components(found.select(F.col("lead").alias("u"), F.col("node").alias("v"))))
        # what joined its leader's component is connected; the others have met the leader alone
        at = led.select("band", "h", "last", "node", "lead").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        led_root = root.select(F.col("node").alias("lead"), F.col("root").alias("lead_root"))
        at = at.join(led_root, "lead", "left").withColumn("out", F.col("root") != F.coalesce("lead_root", "lead"))
        left = keep(at.select("band", "h", "last", "node", "root", "out"))
        size = left.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.count_if("out").alias("x")).where("n > 1 and x > 0")
        # a large rest is refined, by the sketches that two texts must share anyway; after that it is compared in blocks, however large
        final = depth == SHARED - 1
        small = left.join(size if final else size.where(F.col("x") <= limit), ["band", "h"])
        found = found.unionByName(keep(closed(small, texts, threshold, limit, depth)))
        root = keep(components(found.select(F.col("lead").alias("u"), F.col("node").alias("v"))))
        if final:
            break
        large = left.join(size.where(F.col("x") > limit), ["band", "h"], "left_semi").select("band", "h", "last", "node")
        more = large.join(bands.select("node", F.col("band").alias("band2"), F.col("h").alias("h2")), "node").where("band2 > last")
        finer = more.select("node", F.xxhash64("band", "h").alias("band"), F.xxhash64("band", "h", "band2", "h2").alias("h"), F.col("band2").alias("last"))
        twice = finer.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        finer = finer.join(twice, ["band", "h"], "left_semi")
        rest = keep(finer.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "band", "h", "last"))
    for df in made:
        if df is not root:
            drop(df)
    return root if root is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, hot: int = HOT) -> DataFrame:
    """Inner join with ``right``, which has each key once and says in ``n`` how many rows of ``left`` have it: those of more than ``hot`` are
    broadcast, so that no task gets all the rows of a key."""
    many = right.where(F.col(n) > hot)
    if not many.limit(1).count():
        return left.join(right, key)
    few = left.join(F.broadcast(many.select(key)), key, "left_anti").join(right.where(F.col(n) <= hot), key)
    return left.join(F.broadcast(many), key).unionByName(few)


def labelled(docs: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """doc_id, node, root, class_id (smallest doc_id of the class) and class_size of each row; no text is shuffled for it."""
    narrow = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("node"))
    own = narrow.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    own = cut(own.join(classes(docs, threshold), "node", "left").withColumn("root", F.coalesce("root", "node")))
    by = cut(own.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")))
    own = cut(spread_join(own.select("node", "root", "copies"), by, "root", "texts", hot).drop("texts"))
    return spread_join(narrow, own, "node", "copies", hot).drop("copies")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of its smallest doc_id (ids that are null come last), with all its columns. Rows that
    share id and text are told apart by nothing that matters; one of them stays."""
    full = cut(labelled(docs.select("doc_id", "text"), threshold))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("first")
    keep = full.groupBy("root").agg(first).select(F.col("first.doc_id").alias("keep_id"), F.col("first.node").alias("keep_node"))
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("node"))
    kept = boxed.join(keep, F.col("row.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node")), "left_semi")
    twice = full.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (kept.groupBy("row.doc_id", "node").agg(F.first("row").alias("row")) if twice else kept).select("row.*")


def op3_order_minhash(spark, sf_dir):
    return labelled(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
