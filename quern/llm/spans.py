"""Long verbatim spans shared between documents: anchors bring texts together, suffix automata find the spans.

An automaton of the whole corpus fits no machine, and streaming the corpus past the automata of all its shards is
quadratic. So shards are formed from texts that can share a span: every span of ``least`` characters holds, by
winnowing, at least one common anchor, and around it a common block. Texts with a common block meet in a shard named
after the least of them; there one suffix automaton of the shard's distinct passages is streamed by each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import materialise, ship, spread

LEAST = 400
#: Blocks held by more texts than this are no shard: their texts are matched by all their spans of LEAST characters.
HOT = 64
#: A text leads one shard for each stretch of so many characters, which bounds a shard: blocks of a stretch, HOT texts each.
STRETCH = 4096
#: Rows of one group that one task pairs with all others of it.
BLOCK = 1024
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n, _CHUNK + 1)
        _POWERS["up"], _POWERS["down"] = _powers(size, _BASE), _powers(size, _INVERSE)
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all windows of a text, for any width."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        up, self.down = _tables(self.n)
        self.sums = np.zeros(self.n + 1, "u8")
        np.cumsum(_mixed(codes.astype("u8") + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def grams(self, width: int) -> np.ndarray:
        """Hash of each window of ``width`` characters; empty if there is none."""
        m = max(0, self.n - width + 1)
        return _mixed((self.sums[width : width + m] - self.sums[:m]) * self.down[:m])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo("u8").max, "u8")
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def anchors(texts: list[str], least: int) -> list[np.ndarray]:
    """Hashes of the anchors of each text: the least hash of every ``least``-character window's half-width grams."""
    gram = least // 2
    out = [np.zeros(0, "u8")] * len(texts)
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= _CHUNK):
            size += len(texts[stop])
            stop += 1
        whole = codes("".join(texts[at:stop]))
        if len(whole) >= least:
            low = sliding_min(Rolling(whole).grams(gram), least - gram + 1)
            start = 0
            for k in range(at, stop):
                n = len(texts[k])
                if n >= least:
                    own = low[start : start + n - least + 1]
                    out[k] = np.unique(own[np.r_[True, own[1:] != own[:-1]]])
                start += n
        at = stop
    return out


class Automaton:
    """Suffix automaton of passages, which knows where each of their spans stands first."""

    def __init__(self, least: int):
        self.least = least
        self.next: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def _extend(self, symbol) -> None:
        nexts, link, length, end = self.next, self.link, self.length, self.end
        new = len(nexts)
        nexts.append({})
        length.append(length[self.last] + 1)
        end.append(self.size)
        link.append(0)
        p = self.last
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                end.append(end[q])
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        self.last = new
        self.size += 1

    def add(self, passage: str) -> None:
        self._extend(self.size)  # an integer is a separator that no text holds
        for symbol in passage:
            self._extend(symbol)

    def stream(self, text: str) -> list[list[int]]:
        """[start in the text, start among the passages, number] of runs of spans of ``least`` characters."""
        nexts, link, length, end, least = self.next, self.link, self.length, self.end, self.least
        runs: list[list[int]] = []
        state = matched = 0
        for i, symbol in enumerate(text):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            found = nexts[state].get(symbol)
            if found is None:
                continue
            state = found
            matched += 1
            if matched >= least:
                while length[link[state]] >= least:
                    state = link[state]
                    matched = length[state]
                start, place = i - least + 1, end[state] - least + 1
                if runs and runs[-1][0] + runs[-1][2] == start and runs[-1][1] + runs[-1][2] == place:
                    runs[-1][2] += 1
                else:
                    runs.append([start, place, 1])
        return runs


def shard_links(texts: list[tuple[int, list[tuple[int, str]]]], least: int):
    """(a, b, start in a, start in b, length) of the spans that the texts of a shard share.

    ``texts`` has each text's id and passages (offset, text). Windows of ``least`` characters get one place each
    among the distinct passages, however many texts hold them; texts share a span where their places overlap.
    """
    known = Automaton(least)
    places: list[tuple[int, int, int, int]] = []  # place, end of places, text, offset in the text
    for k, (text_id, passages) in enumerate(texts):
        for offset, passage in passages:
            runs = known.stream(passage) if known.size else []
            novel, at = [], 0
            for start, _, number in [*runs, [len(passage) - least + 1, 0, 0]]:
                if start > at:
                    novel.append(passage[at : start + least - 1])
                at = max(at, start + number)
            if novel and k + 1 < len(texts):
                for new in novel:
                    known.add(new)
                runs = known.stream(passage)
            places += [(place, place + number, text_id, offset + start) for start, place, number in runs]
    places.sort()
    active: list[tuple[int, int, int, int]] = []
    for one in places:
        place, stop, text_id, start = one
        active = [x for x in active if x[1] > place]
        for first, until, other, at in active:
            if other != text_id:
                number = min(stop, until) - place
                a, b = (text_id, start), (other, at + place - first)
                if a > b:
                    a, b = b, a
                yield a[0], b[0], a[1], b[1], number + least - 1
        active.append(one)


def _merged(starts: np.ndarray, before: int, after: int, n: int) -> list[tuple[int, int]]:
    """Union of the ranges around ``starts`` within a text of ``n`` characters."""
    out: list[list[int]] = []
    for s in np.sort(starts).tolist():
        low, high = max(0, s - before), min(n, s + after)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def paired(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Pairs (less, greater) of the keys of each group whose size is ``c``.

    Used where the pairs themselves are the result. A large group is dealt out: each of its rows is a partner in one
    block of about BLOCK rows and is sent to all blocks, so no task pairs a whole group.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    left = rows.select(*group, F.col(key).alias("_a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    right = rows.select(*group, F.col(key).alias("_b"), F.pmod(F.xxhash64(key), blocks).cast("int").alias("_block"))
    return left.join(right, [*group, "_block"]).filter("_a < _b").select("_a", "_b")


class Shared:
    """Shared spans of a table of documents.

    ``copies``: ``doc_id, rep, n`` of each document of at least ``least`` characters (``rep`` is the least id with
    exactly its text). ``links``: ``a, b, start_a, start_b, n`` of spans between representatives of different texts; ``hot_pairs`` and
    ``hot_spans`` are those of passages that more than ``hot`` texts hold.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST, hot: int = HOT):
        spark = documents.sparkSession
        ship(spark)
        step = least // 8  # a window of ``least`` holds a block of ``least - step`` at a multiple of ``step`` from its anchor
        block, gram = least - step, least // 2
        long = documents.select("doc_id", "text").filter(F.length("text") >= least)

        def find(batches):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = anchors(texts, least)
                digests = [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
                halves = [np.array([d >> 64 for d in digests], "u8").view("i8"), np.array([d & (1 << 64) - 1 for d in digests], "u8").view("i8")]
                ends = np.cumsum([0, *map(len, found)]).astype("i4")
                values = pa.array((np.concatenate(found) if found else np.zeros(0, "u8")).view("i8"))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, halves), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "h1", "h2", "n", "anchors"])

        marked = materialise(spread(long).mapInArrow(find, "doc_id bigint, h1 bigint, h2 bigint, n bigint, anchors array<bigint>"), "anchors")
        first = marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
        self.copies = marked.select("doc_id", "h1", "h2", "n").join(first, ["h1", "h2"]).select("doc_id", "rep", "n")
        own = marked.join(first.select(F.col("rep").alias("doc_id")), "doc_id").select("doc_id", F.explode("anchors").alias("anchor"))
        several = own.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
        wanted = own.join(several, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        texts = materialise(long.join(wanted, "doc_id"), "passages")  # the only shuffle of texts

        def blocks(batches):
            for batch in batches:
                docs, keys, starts = [], [], []
                for doc, text, own_anchors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    rolling = Rolling(codes(text.as_py()))
                    at = np.flatnonzero(np.isin(rolling.grams(gram), own_anchors.values.to_numpy().view("u8")))
                    at = np.unique((at[:, None] - step * np.arange((least - gram) // step + 1)).ravel())
                    hashes = rolling.grams(block)
                    at = at[(at >= 0) & (at < len(hashes))]
                    docs.append(np.full(len(at), doc, "i8"))
                    keys.append(hashes[at].view("i8"))
                    starts.append(at.astype("i4"))
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, keys, starts)], ["doc_id", "key", "start"])

        keyed = materialise(texts.mapInArrow(blocks, "doc_id bigint, key bigint, start int"), "blocks")
        # a block's texts meet in the shard of its least text, by places of STRETCH characters of that text
        held = keyed.groupBy("key", "doc_id").agg(F.min("start").alias("start")).groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start")).alias("first")).filter("c > 1")
        held = held.select("key", "c", F.xxhash64("first.doc_id", F.floor(F.col("first.start") / STRETCH)).alias("shard"))
        placed = keyed.join(held, "key")
        cold = placed.filter(F.col("c") <= hot).groupBy("shard", "doc_id").agg(F.collect_set("start").alias("starts"))

        def cut(batches):
            for batch in batches:
                rows = []
                for shard, doc, starts, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    # spans of ``least`` that hold the block, and no more
                    for low, high in _merged(np.array(starts), step, least, len(text)):
                        if high - low >= least:
                            rows.append((shard, doc, low, text[low:high]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["shard", "doc_id", "start", "passage"])

        passages = cold.join(texts.select("doc_id", "text"), "doc_id").select("shard", "doc_id", "starts", "text").mapInArrow(cut, "shard bigint, doc_id bigint, start int, passage string")

        def match(batches):
            shard, members, rows = None, [], []

            def flush():
                if len(members) > 1:
                    rows.extend(shard_links(members, least))
                members.clear()

            def out():
                batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.int32()) for i in range(5)], ["a", "b", "start_a", "start_b", "n"])
                rows.clear()
                return batch

            for batch in batches:
                for now, doc, start, passage in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if now != shard:
                        flush()
                        shard = now
                    if not members or members[-1][0] != doc:
                        members.append((doc, []))
                    members[-1][1].append((start, passage))
                yield out()
            flush()
            yield out()

        schema = "a bigint, b bigint, start_a int, start_b int, n int"
        links = passages.repartition("shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(match, schema)

        def windows(batches):
            for batch in batches:
                docs, h1, h2, at_all, firsts = [], [], [], [], []
                for doc, starts, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    points = codes(text)
                    grams = Rolling(points).grams(least)
                    other = Rolling(points[::-1]).grams(least)[::-1]
                    at = np.unique((np.array(starts)[:, None] - np.arange(step + 1)).ravel())
                    at = at[(at >= 0) & (at < len(grams))]
                    at = at[np.lexsort((at, other[at], grams[at]))]
                    x, y = grams[at], other[at]
                    docs.append(np.full(len(at), doc, "i8"))
                    h1.append(x.view("i8"))
                    h2.append(y.view("i8"))
                    at_all.append(at.astype("i4"))
                    firsts.append(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(at)])
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, h1, h2, at_all, firsts)], ["doc_id", "h1", "h2", "start", "first"])

        hot_starts = placed.filter(F.col("c") > hot).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
        places = hot_starts.join(texts.select("doc_id", "text"), "doc_id").mapInArrow(windows, "doc_id bigint, h1 bigint, h2 bigint, start int, first boolean")
        places = materialise(places, "windows")
        found = places.filter("first").drop("first")  # a window once a text, for the pairs; spans are made of all places
        groups = found.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc_id")).alias("docs")).filter("c > 1")
        self.links = links
        self.hot_spans = places.join(groups, ["h1", "h2"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("start").alias("s"), (F.col("start") + least).alias("e"))
        # the windows of one passage have the same texts: one of them is enough for their pairs
        one = groups.groupBy("c", "docs").agg(F.min(F.struct("h1", "h2")).alias("w")).select("w.h1", "w.h2", "c")
        self.hot_pairs = paired(found.join(one, ["h1", "h2"]), ["h1", "h2"], "doc_id").toDF("a", "b")

    def pairs(self) -> DataFrame:
        """``doc_a, doc_b`` (``doc_a < doc_b``) of all documents that share a span, derived from the classes, copies included."""
        members = self.copies.select("doc_id", "rep")
        x, y = members.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
        between = self.class_links().join(x, "a").join(y, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
        many = members.groupBy("rep").agg(F.count("*").alias("c")).filter("c > 1")
        within = paired(members.join(many, "rep"), ["rep"], "doc_id").toDF("doc_a", "doc_b")
        return between.unionByName(within)

    def classes(self) -> DataFrame:
        """``doc_id, rep, copies, partners`` of each document that shares a span: its class of exact copies and how many
        other classes share a span with it. With ``class_links`` this holds all pairs without expanding copies."""
        members = self.copies.groupBy("rep").agg(F.count("*").alias("copies"))
        ends = self.class_links().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("partners"))
        known = members.join(ends, "rep", "left").filter("copies > 1 or partners > 0").select("rep", "copies", F.coalesce("partners", F.lit(0)).cast("bigint").alias("partners"))
        return self.copies.select("doc_id", "rep").join(known, "rep").select("doc_id", "rep", "copies", "partners")

    def class_links(self) -> DataFrame:
        """``a, b`` (representatives, ``a < b``) of different texts that share a span, each once."""
        return self.links.select("a", "b").unionByName(self.hot_pairs).distinct()

    def coverage(self) -> DataFrame:
        """``doc_id, n_chars, shared_chars, share, spans ARRAY<STRUCT<start, end>>`` of each document that shares a span."""
        ends = self.links.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("n")).alias("e")), F.struct(F.col("b").alias("rep"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("n")).alias("e")))).alias("x")).select("x.*").unionByName(self.hot_spans).distinct()
        many = self.copies.groupBy("rep").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c > 1").select("rep", F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))
        order = Window.partitionBy("rep").orderBy("s", "e")
        before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)
        islands = ends.unionByName(many).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = islands.groupBy("rep", "island").agg(F.min("s").alias("start"), F.max("e").alias("end"))
        whole = merged.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
        return self.copies.join(whole, "rep").select("doc_id", F.col("n").alias("n_chars"), "shared_chars", (F.col("shared_chars") / F.col("n")).alias("share"), "spans")


def shared_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of documents that share a verbatim span of at least ``least`` characters: ``doc_a, doc_b``.

    Characters are code points, white space and case included. Null, empty and shorter texts share nothing; copies
    of a text pair with each other and with all that share a span with it; an empty table gives no rows; other
    columns are ignored. ``doc_id`` is unique.
    """
    return Shared(documents, least).pairs()


def shared_spans(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Merged spans of each document that stand elsewhere too, and their share of its text; see ``Shared.coverage``."""
    return Shared(documents, least).coverage()


def shared_classes(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row a document that shares a span: its class of copies and its number of links; see ``Shared.classes``."""
    return Shared(documents, least).classes()
