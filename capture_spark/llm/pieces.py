"""SentencePiece encoding and decoding with n-best segmentations.

The vocabulary comes from a model file; nothing is trained.  The score of a
segmentation is the sum of its pieces' scores.  A blank is the piece mark, one
is put before the text, and characters without a piece are spelled in byte
pieces.  As no piece has a mark after another character, the lattice of a text
falls into chunks, each beginning with its blanks, and a path through the text
is one path through each chunk.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a mark in the text itself is matched as: no valid text and no piece has it.
OTHER = "\ud800"
N_BEST = 3
CACHED = 1 << 19
SLICE = 2 << 20
SHORT = 24  # characters of a chunk whose paths are found with others
TOGETHER = 16384
UNSEEN = -1e8  # floor for pieces that the model scores as never to be used


class Vocabulary:
    """Pieces with scores and ids; ``bytes`` are the ids of the byte pieces.

    A unigram model's scores are log probabilities.  A merge model's are ranks,
    0, -1, -2 ...; sums of ranks would favour many short pieces over one long,
    so a rank r counts as the log probability that Zipf's law gives it,
    1 / (r + 1) over the sum of that for all ranks, and a piece that no merge
    makes as the last rank.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, self.bytes = {}, [0] * 256
        self.names = [p.id_to_piece(i) for i in range(p.vocab_size())]
        for i, name in enumerate(self.names):
            if p.is_byte(i):
                self.bytes[int(name[1:-1], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.pieces[name] = (max(p.get_score(i), UNSEEN), i)
        ranks = [-s for s, _ in self.pieces.values() if s > UNSEEN]
        if all(r >= 0 and r == int(r) for r in ranks) and len(set(ranks)) == len(ranks):
            whole = math.log(sum(1 / (r + 1) for r in ranks))
            self.pieces = {name: (-math.log(1 + min(-s, len(ranks))) - whole, i) for name, (s, i) in self.pieces.items()}
        self.longest = max(map(len, self.pieces), default=1)
        #: Every beginning of a piece: its (score, id), or nothing where it is no piece itself.
        self.prefixes: dict[str, tuple] = {name[:k]: () for name in self.pieces for k in range(1, len(name))}
        self.prefixes.update(self.pieces)
        self.spelled = min((s for s, _ in self.pieces.values() if s > UNSEEN), default=0.0) - 10.0
        raw = [name.replace(MARK, " ").encode() for name in self.names]
        for k, i in enumerate(self.bytes):
            raw[i] = bytes([k])
        self.raw = pa.array(raw, pa.binary())
        # The trie of all beginnings: node << 21 | character leads to the next node; node 0 is the empty one.
        number = {"": 0} | {name: k + 1 for k, name in enumerate(self.prefixes)}
        keys = np.array([number[name[:-1]] << 21 | ord(name[-1]) for name in self.prefixes], np.int64)
        by = np.argsort(keys)
        self.keys, self.child = keys[by], (by + 1).astype(np.int64)
        self.node_score = np.array([-np.inf, *[x[0] if x else -np.inf for x in self.prefixes.values()]])
        self.node_id = np.array([-1, *[x[1] if x else -1 for x in self.prefixes.values()]], np.int32)

    def edges_into(self, chunk: str, at: int) -> list[tuple[int, float]]:
        """(start, score) of the pieces that end at a place; a character without a piece is one spelled edge."""
        found = [(at - k, self.pieces[chunk[at - k : at]][0]) for k in range(1, min(self.longest, at) + 1) if chunk[at - k : at] in self.pieces]
        if not found or found[0][0] != at - 1:
            found.insert(0, (at - 1, self.spelled))
        return found

    def ids(self, said: str, chunk: str, cuts: list[int]) -> list[int]:
        """The ids of the pieces between cuts; ``said`` is the text of the chunk, for what has no piece."""
        out: list[int] = []
        for a, b in zip([0, *cuts], cuts, strict=False):
            got = self.pieces.get(chunk[a:b])
            out += [got[1]] if got else [self.bytes[x] for x in said[a:b].encode()]
        return out

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The bytes of the ids put together, and where each begins."""
        got = self.raw.take(pa.array(ids, pa.int32()))
        return np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1], got.buffers()[2].to_pybytes() if len(ids) else b""

    def decode(self, ids: list[int]) -> str:
        text = self.joined(np.array(ids, np.int32))[1].decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def matched(said: str) -> str:
    """A chunk as it is matched with pieces: blanks as marks, marks as no piece has them."""
    return said.replace(MARK, OTHER).replace(" ", MARK)


def forward(chunk: str, v: Vocabulary) -> tuple[list[float], float, list[int]]:
    """Viterbi: the best score from the start to each place, the second best of the whole, and the best path's ends.

    At equal scores the later start wins.
    """
    n = len(chunk)
    prefixes = v.prefixes
    best, second, back = [-np.inf] * (n + 1), [-np.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for at in range(n):
        one, two = best[at], second[at]
        for end in range(at + 1, n + 1):
            got = prefixes.get(chunk[at:end])
            if got:
                score = got[0]
            elif end == at + 1:
                score = v.spelled
            elif got is None:
                break
            else:
                continue
            x = one + score
            if x >= best[end]:
                y = best[end]
                second[end] = y if y > two + score else two + score
                best[end] = x
                back[end] = at
            else:
                y = x if x > two + score else two + score
                if y > second[end]:
                    second[end] = y
            if got is None:
                break
    cuts, at = [], n
    while at:
        cuts.append(at)
        at = back[at]
    return best, second[n], cuts[::-1]


def forward_all(chunks: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``forward`` for many chunks: best score, second best, the ids of the best paths put together and their counts.

    A character without a piece has id -1.  The trie is walked from every
    character of all chunks at once, and chunks of one length go through the
    places together.
    """
    sizes = np.array([len(c) for c in chunks], np.int64)
    by = np.argsort(sizes, kind="stable")
    points = np.frombuffer("".join([chunks[i] for i in by]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    longest = min(v.longest, int(sizes.max()))
    score = np.full((longest + 1, len(points)), -np.inf)
    ident = np.full((longest + 1, len(points)), -1, np.int32)
    place, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for k in range(1, longest + 1):
        inside = place + k <= len(points)
        place, node = place[inside], node[inside]
        key = node << 21 | points[place + k - 1]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        hit = v.keys[at] == key
        place, node = place[hit], v.child[at[hit]]
        score[k, place], ident[k, place] = v.node_score[node], v.node_id[node]
    bare = np.isneginf(score[1])
    score[1, bare], ident[1, bare] = v.spelled, -1

    best_of, second_of = np.zeros(len(chunks)), np.zeros(len(chunks))
    owner, ends_at, ids = [], [], []
    done = 0
    for size in np.unique(sizes).tolist():
        rows = by[done : done + int((sizes == size).sum())]
        base = int(sizes[by[:done]].sum())
        m = len(rows)
        done += m
        table = np.ascontiguousarray(score[:, base : base + m * size].reshape(-1, m, size).transpose(0, 2, 1))
        named = ident[:, base : base + m * size].reshape(-1, m, size)
        best, second, back = np.full((size + 1, m), -np.inf), np.full((size + 1, m), -np.inf), np.zeros((size + 1, m), np.int64)
        best[0] = 0.0
        for end in range(1, size + 1):
            b, s, k_best = best[end], second[end], back[end]
            for k in range(min(longest, end), 0, -1):
                step = table[k, end - k]
                x = best[end - k] + step
                np.maximum(np.maximum(s, second[end - k] + step, out=s), np.minimum(b, x), out=s)
                k_best[x >= b] = k
                np.maximum(b, x, out=b)
        best_of[rows], second_of[rows] = best[size], second[size]
        here, who = np.full(m, size), np.arange(m)
        while len(who):
            k = back[here, who]
            here = here - k
            owner.append(rows[who])
            ends_at.append(here)
            ids.append(named[k, who, here])
            who, here = who[here > 0], here[here > 0]
    owner_, ends_, ids_ = np.concatenate(owner), np.concatenate(ends_at), np.concatenate(ids)
    order = np.lexsort((ends_, owner_))
    return best_of, second_of, ids_[order], np.bincount(owner_, minlength=len(chunks))


def n_best(chunk: str, v: Vocabulary, n: int) -> list[tuple[float, list[int]]]:
    """The n best (score, ends of pieces) by A* from the end.

    The forward scores are the exact cost to go, so paths leave the queue in
    order.  A path is a link to the one that it continues.  Of the paths to one
    place only the first n can be part of the n best, so a place is left n times
    at most and work grows with the chunk's length, also where scores tie.  The
    Viterbi path comes first; other ties go to the path nearest to its start.
    """
    best, _, viterbi = forward(chunk, v)
    left = [0] * (len(chunk) + 1)
    links: list[tuple[int, int]] = []
    queue: list[tuple[float, int, float, int]] = [(-best[-1], len(chunk), 0.0, -1)]
    found: list[tuple[float, list[int]]] = []
    while queue and len(found) < n:
        _, at, done, before = heapq.heappop(queue)
        if left[at] == n:
            continue
        left[at] += 1
        if at == 0:
            cuts, k = [], before
            while k >= 0:
                cuts.append(links[k][0])
                k = links[k][1]
            found.append((done, cuts))
            continue
        links.append((at, before))
        for start, score in v.edges_into(chunk, at):
            if left[start] < n:
                heapq.heappush(queue, (-(best[start] + score + done), start, done + score, len(links) - 1))
    return [(best[-1], viterbi), *[x for x in found if x[1] != viterbi]][:n]


class Encoder:
    """Encodes batches of texts; keeps the best paths of the chunks met, ``CACHED`` of them at most between batches.

    A worker lives on after its task, so what is kept is packed: chunks are found
    by a sorted array of hashes and compared by their bytes, and the paths found
    from the end are one string of bytes for each chunk.
    """

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n = v, n
        self.searched: dict[bytes, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.said, self.said_ends = bytearray(), array("q", [0])
        self.ids, self.ends, self.best, self.loss = array("i"), array("q", [0]), array("d"), array("d")

    def _known(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slots of chunks, by hash and bytes; -1 for those not kept."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ends = np.frombuffer(self.said_ends, np.int64)
        slot = self.slots[at].astype(np.int64)
        size = end - start
        who = np.flatnonzero((self.hashes[at] == hashes) & (ends[slot + 1] - ends[slot] == size))
        size, slot = size[who], slot[who]
        upto = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(upto, size)
        same = np.frombuffer(self.said, np.uint8)[np.repeat(ends[slot], size) + step] == data[np.repeat(start[who], size) + step]
        equal = np.logical_and.reduceat(same, upto) if len(who) else np.zeros(0, bool)
        out[who[equal]] = slot[equal]
        return out

    def _add(self, new: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Put the best paths of new chunks into slots; of chunks with one hash the first is found again."""
        said = [c.decode() for c in new]
        slots = np.full(len(new), -1, np.int64)
        fit = [k for k, c in enumerate(said) if len(c) <= SHORT]
        for start in range(0, len(fit), TOGETHER):
            short = fit[start : start + TOGETHER]
            best, second, ids, counts = forward_all([matched(said[k]) for k in short], self.v)
            ends = np.cumsum(counts)
            spelled = np.add.reduceat(ids < 0, ends - counts) > 0
            own = self.ends[-1]
            keep = ~spelled
            self.ids.frombytes(ids[np.repeat(keep, counts)].astype(np.int32).tobytes())
            self.ends.frombytes((own + np.cumsum(counts[keep])).astype(np.int64).tobytes())
            self.loss.frombytes((best - second)[keep].tobytes())
            first = len(self.best)
            self.best.frombytes(best[keep].tobytes())
            slots[np.array(short)[keep]] = first + np.arange(int(keep.sum()))
        for k in np.flatnonzero(slots < 0).tolist():  # long, or with characters that have no piece
            chunk = matched(said[k])
            best, second, cuts = forward(chunk, self.v)
            self.ids.extend(self.v.ids(said[k], chunk, cuts))
            self.ends.append(len(self.ids))
            self.loss.append(best[-1] - second)
            slots[k] = len(self.best)
            self.best.append(best[-1])
        by = np.argsort(slots).tolist()
        for k in by:
            self.said += new[k]
            self.said_ends.append(len(self.said))
        every = np.concatenate([self.hashes, hashes])
        _, first = np.unique(every, return_index=True)
        self.slots = np.concatenate([self.slots, slots.astype(np.int32)])[first]
        self.hashes = every[first]
        return slots

    def _paths(self, raw: bytes) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of the n best paths of a chunk."""
        packed = self.searched.get(raw)
        if packed is not None:
            rows = packed[0]
            losses, sizes = np.frombuffer(packed, np.float64, rows, 8), np.frombuffer(packed, np.int32, rows, 8 + 8 * rows)
            ids = np.frombuffer(packed, np.int32, offset=8 + 12 * rows)
            ends = np.cumsum(sizes).tolist()
            return [(loss, ids[end - size : end]) for loss, size, end in zip(losses.tolist(), sizes.tolist(), ends, strict=True)]
        said = raw.decode()
        chunk = matched(said)
        found = n_best(chunk, self.v, self.n)
        got = [(max(found[0][0] - s, 0.0), np.array(self.v.ids(said, chunk, cuts), np.int32)) for s, cuts in found]
        if len(raw) <= 64 and len(got) < 256:
            if len(self.searched) >= CACHED // 8:
                self.searched.clear()
            sizes = np.array([len(x) for _, x in got], np.int32)
            self.searched[raw] = len(got).to_bytes(8, "little") + np.array([x for x, _ in got]).tobytes() + sizes.tobytes() + b"".join(x.tobytes() for _, x in got)
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[int], list[int], list[list[float]], list[list[bool]], pa.Array]:
        """Ids of all paths, the end of each path in them, the end of each text in the paths; scores and round trips by text; what each first path decodes to.

        Chunks are told apart by a hash of their bytes within a batch, and met
        once each.  The n best paths of a text leave the best path in the n - 1
        chunks of least loss at most, so only these are searched from their end.
        """
        n = self.n
        if len(self.best) >= CACHED or max(len(self.ids), len(self.said)) >= 16 * CACHED:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        full = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        mine = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(full)), pa.scalar("", pa.large_string())) if len(full) else texts[:0]
        at = np.frombuffer(mine.buffers()[1], np.int64)[mine.offset : mine.offset + len(full) + 1] if len(full) else np.zeros(1, np.int64)
        raw = mine.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(full) else b""
        at = at - at[0]
        data = np.frombuffer(raw, np.uint8)
        blank = data == 0x20
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[at[:-1]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data)).astype(np.int64) if len(start) else start
        top = np.searchsorted(start, at[:-1])  # the first chunk of each text
        hashes, where, back = np.unique(tx.span_hashes(data, start, end), return_index=True, return_inverse=True)
        found = self._known(hashes, data, start[where], end[where])
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._add([raw[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)], hashes[new])
        slots = found[back]
        ids, ends = np.frombuffer(self.ids, np.int32) if self.ids else np.zeros(0, np.int32), np.frombuffer(self.ends, np.int64)
        sizes = ends[slots + 1] - ends[slots]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(ends[slots] - upto[:-1], sizes) + np.arange(upto[-1])]
        total = np.add.reduceat(np.frombuffer(self.best)[slots], top).tolist() if len(top) else []
        loss = np.frombuffer(self.loss)[slots] if len(slots) else np.zeros(0)
        del ids, ends
        bottom = np.append(top[1:], len(start))
        picks: list[list[tuple[float, int]]] = [[] for _ in full]
        of = np.repeat(np.arange(len(full)), bottom - top)
        for _ in range(n - 1 if len(top) else 0):
            least = np.minimum.reduceat(loss, top)
            hit = np.flatnonzero((loss == least[of]) & (loss < np.inf))
            who, one = np.unique(of[hit], return_index=True)
            for t, i in zip(who.tolist(), hit[one].tolist(), strict=True):
                picks[t].append((float(least[t]), i))
            loss[hit[one]] = np.inf

        parts, path_ends, done, scores, paths_of = [], [], 0, [[0.0] for _ in range(len(texts))], np.ones(len(texts), np.int64)
        t = 0
        for k in range(len(texts)):
            if t == len(full) or full[t] != k:
                path_ends.append(done)
                continue
            low, high = int(upto[top[t]]), int(upto[bottom[t]])
            sums: list[tuple[float, tuple]] = [(0.0, ())]
            for _, i in picks[t]:
                other = self._paths(raw[start[i] : end[i]])
                sums = heapq.nsmallest(n, [(lost + more, (*took, (i, x)) if j else took) for lost, took in sums for j, (more, x) in enumerate(other)], key=lambda x: x[0])
            for _, took in sums:
                at_id = low
                for i, x in sorted(took, key=lambda x: x[0]):
                    parts += [flat[at_id : upto[i]], x]
                    done += int(upto[i]) - at_id + len(x)
                    at_id = int(upto[i + 1])
                parts.append(flat[at_id:high])
                done += high - at_id
                path_ends.append(done)
            scores[k] = [total[t] - lost for lost, _ in sums]
            paths_of[k] = len(sums)
            t += 1
        every = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)
        row_ends = np.cumsum(paths_of).tolist()
        byte_at, made = self.v.joined(every)
        places = [0, *byte_at[np.array(path_ends, np.int64)].tolist()] if len(every) else [0] * (len(path_ends) + 1)
        trips, firsts, t, path = [], [], 0, 0
        for k, rows in enumerate(paths_of.tolist()):
            want = b""
            if t < len(full) and full[t] == k:
                want = raw[at[t] : at[t + 1]]
                t += 1
            got = [made[places[path + j] : places[path + j + 1]] for j in range(rows)]
            trips.append([x == want for x in got])
            firsts.append(got[0][1:])
            path += rows
        return every, path_ends, row_ends, scores, trips, pa.array(firsts, pa.binary()).cast(pa.string())


_of_worker: dict[tuple[bytes, int], Encoder] = {}


def of_worker(model: bytes, n: int) -> Encoder:
    """The encoder with the chunks met so far, kept by a Python worker from task to task."""
    if (model, n) not in _of_worker:
        _of_worker.clear()
        _of_worker[model, n] = Encoder(Vocabulary(model), n)
    return _of_worker[model, n]


def encoded(docs: DataFrame, model: str = MODEL, n: int = N_BEST, text: str = "text") -> DataFrame:
    """Add ``ids`` (array), ``paths`` (array of arrays, n at most), ``best_scores`` and ``round_trips`` (arrays, one place for each path) and ``decoded`` (string) to each row of ``docs``.

    ``paths`` has the ids of the n best segmentations in order, ``best_scores``
    their scores, and ``round_trips`` whether each decodes to the text; ``ids`` is
    the first of them, and ``decoded`` the text that it gives back.  At equal
    scores the paths' order is fixed, by where pieces start.
    One pass without a shuffle; a worker keeps the best paths of the chunks it has met,
    ``CACHED`` at most.  Texts are taken in slices, a very long one alone, and
    work grows with their length, blanks or none.  Null and empty texts have one
    path without ids; repeated rows are encoded each, an empty table gives no
    rows; extra columns ride along, and those with these names are replaced.
    """
    with open(model, "rb") as f:
        data = f.read()
    made = ("ids", "paths", "best_scores", "round_trips", "decoded")
    source = docs.select(*[c for c in docs.columns if c not in made])
    types = {"paths": "array<array<int>>", "best_scores": "array<double>", "round_trips": "array<boolean>"}
    schema = source.withColumns({**{c: F.lit(None).cast(t) for c, t in types.items()}, "decoded": F.lit("")}).schema

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(data, n)
        for b in tx.slices(batches, text, SLICE):
            ids, path_ends, row_ends, scores, trips, decoded = encoder.encode(b.column(b.schema.get_field_index(text)))
            flat = tx.list_array(ids, np.array(path_ends), pa.int32())
            nested = pa.ListArray.from_arrays(pa.array([0, *row_ends], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, nested, pa.array(scores, pa.list_(pa.float64())), pa.array(trips, pa.list_(pa.bool_())), decoded], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from slices(batches)
        tx.give_back()

    return source.mapInArrow(run, schema).withColumn("ids", F.col("paths")[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, best_scores, ids_sha256, round_trip, path_n_ids, path_sha256, path_round_trips) of all documents: of the best path, then of each of the n best."""
    got = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = F.transform("paths", lambda p: F.sha2(F.array_join(p.cast("array<string>"), " "), 256))
    counts = F.transform("paths", lambda p: F.size(p).cast("long"))
    got = got.select("doc_id", "best_scores", counts.alias("path_n_ids"), digests.alias("path_sha256"), F.col("round_trips").alias("path_round_trips"))
    first = [F.col(f"path_{c}")[0] for c in ("n_ids", "sha256", "round_trips")]
    return got.select("doc_id", first[0].alias("n_ids"), "best_scores", first[1].alias("ids_sha256"), first[2].alias("round_trip"), "path_n_ids", "path_sha256", "path_round_trips")
