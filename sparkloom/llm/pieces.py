"""SentencePiece encoding and decoding with N-best segmentations.

A text's piece lattice has an edge for every vocabulary piece at every position,
and for a character that no piece covers an edge of its UTF-8 bytes' pieces.  A
path's score is the sum of its pieces' scores.  Forward Viterbi scores are the
exact cost of the best way back to the start, so they serve as heuristic for A*
search backward from the end: paths leave the queue in order of their score.

No piece of the model continues from other characters into a space mark, nor
holds a line feed; both are checked when it is loaded.  Every path therefore
passes each start of a word, and the lattice is a chain of word lattices: a
word's best path and the loss of its second best are kept per distinct word.
The N best paths of a text deviate only at the N - 1 words of smallest loss; those
words' N best are found by A* and merged; each of the N paths is the best one with
the ids of those words replaced.  All N are put together and decoded again.

Cases: a null or empty text has no pieces, one path of score 0; a long text costs
time in proportion to its length; ties between paths are kept in the order found,
which is the same in every run; repeated rows and null ids are encoded each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from heapq import merge as merge_sorted

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

MODEL = "piece_bpe_32k.model"
NBEST = 4
SPACE = "▁"
KEPT_BYTES = 200 << 20
BATCH_BYTES = 4 << 20  # ids of a batch that goes back to Spark
SHORT = 1 << 12  # words from this length on are held in arrays, and not kept
UNKNOWN_LOSS = 10.0


class Pieces:
    """The vocabulary of a SentencePiece model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.text: list[bytes] = []
        self.parts = None
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.score[piece] = (i, sp.get_score(i))
                self.text.append(piece.replace(SPACE, " ").encode())
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses the start of a word")
        self.longest = max(map(len, self.score))
        self.matcher = ahocorasick.Automaton()  # finds all pieces in a word, by end and the longest first
        for piece, (i, score) in self.score.items():
            self.matcher.add_word(piece, (len(piece), score, i))
        self.matcher.make_automaton()
        self.single = {piece for piece in self.score if len(piece) == 1}
        self.unknown = min(s for _, s in self.score.values() if s > -1e8) - UNKNOWN_LOSS

    def edges(self, word: str) -> Lattice:
        return Lattice(self, word)

    def best_and_loss(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best path, and how much the second best loses (inf if
        none).  Words whose characters all are pieces, and that aren't long, are done in
        place, the others by their lattice."""
        n, low, loss = len(word), float("-inf"), float("inf")
        if n >= SHORT or not self.single.issuperset(word):
            lattice = Lattice(self, word)
            best, back, other = lattice.forward()
            at = n
            while at:
                loss = min(loss, best[at] - other[at])
                at -= back[at]
            return tuple(lattice.ids(())), best[n], loss
        best, other, back = [0.0] + [low] * n, [low] * (n + 1), [None] * (n + 1)
        for j, edge in self.matcher.iter(word):
            j += 1
            s = best[j - edge[0]] + edge[1]
            if s > best[j]:
                other[j], best[j], back[j] = best[j], s, edge
            elif s > other[j]:
                other[j] = s
        ids, at = [], n
        while at:
            lost = best[at] - other[at]
            if lost < loss:
                loss = lost
            length, _, number = back[at]
            ids.append(number)
            at -= length
        ids.reverse()
        return tuple(ids), best[n], loss

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts in front is left out."""
        return _bare(b"".join([self.text[i] for i in ids]))

    def decode_all(self, paths: list[bytes]) -> list[str]:
        """The texts of several paths, each its ids as little-endian bytes."""
        import numpy as np
        import pyarrow as pa

        if self.parts is None:
            self.parts = pa.array(self.text, pa.large_binary())
        taken = self.parts.take(pa.array(np.frombuffer(b"".join(paths), "<u4")))
        raw, ends = taken.buffers()[2], np.frombuffer(taken.buffers()[1], "<i8")[np.cumsum([0] + [len(x) // 4 for x in paths])].tolist()
        return [_bare(raw[a:b].to_pybytes()) if b > a else "" for a, b in zip(ends, ends[1:])]


def _bare(raw: bytes) -> str:
    out = raw.decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


class Lattice:
    """The piece lattice of a word.  Indexed by an end position it gives (start,
    score, ids) of the edges that end there, which are looked up when asked for."""

    def __init__(self, pieces: Pieces, word: str):
        self.pieces, self.word, self.passed = pieces, word, None

    def __len__(self) -> int:
        return len(self.word) + 1

    def bytes_of(self, i: int, j: int) -> tuple[int, ...]:
        return tuple(self.pieces.byte[b] for b in self.word[i:j].encode("utf-8", "surrogatepass"))

    def __getitem__(self, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        word, get, out = self.word, self.pieces.score.get, []
        for i in range(max(0, j - self.pieces.longest), j):
            if hit := get(word[i:j]):
                out.append((i, hit[1], (hit[0],)))
        if j and word[j - 1] not in self.pieces.score:
            out.append((j - 1, self.pieces.unknown, self.bytes_of(j - 1, j)))
        return out

    def _edges(self):
        """(last position, (length, score, id)) of all edges, by end, the longest first; one of bytes has no id."""
        pieces, word = self.pieces, self.word
        if pieces.single.issuperset(word):
            return pieces.matcher.iter(word)
        bare = ((k, (1, pieces.unknown, -1)) for k, ch in enumerate(word) if ch not in pieces.single)
        return merge_sorted(pieces.matcher.iter(word), bare, key=lambda x: x[0])

    def forward(self):
        """Per position: the Viterbi score, the length of the best edge into it, and the
        best score by any other edge into it.  Edges come by their ends, so the score at
        an edge's start is final."""
        if self.passed:
            return self.passed
        n, low = len(self.word), float("-inf")
        if n < SHORT:
            best, other, back = [0.0] + [low] * n, [low] * (n + 1), [0] * (n + 1)
        else:
            best, other, back = (array(c, [x]) * (n + 1) for c, x in (("d", low), ("d", low), ("H", 0)))
            best[0] = 0.0
        for j, (length, score, _) in self._edges():
            j += 1
            s = best[j - length] + score
            top = best[j]
            if s > top:
                best[j], back[j], other[j] = s, length, top
            elif s > other[j]:
                other[j] = s
        self.passed = best, back, other
        return self.passed

    def ids(self, turns: tuple) -> array:
        """The ids of the path that follows the best edges back from the end, but where
        turns, a chain of ((end, start), earlier turns), says otherwise."""
        back, at, taken, out, get, word = self.forward()[1], len(self.word), {}, array("I"), self.pieces.score.get, self.word
        while turns:
            (end, start), turns = turns
            taken[end] = start
        while at:
            i = taken.get(at, at - back[at])
            if hit := get(word[i:at]):
                out.append(hit[0])
            else:
                out.extend(reversed(self.bytes_of(i, at)))
            at = i
        out.reverse()
        return out


def search(into: Lattice, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths, best first, by backward A* with forward Viterbi scores.

    The heuristic is exact: a state's priority is the score of a whole path, the one
    that goes on by best edges.  A state that leaves the queue is followed along that
    path to the start at once; every other edge on the way makes a new state.  As each
    state stands for a path of its own priority, and no two for the same one, those
    beyond the n - len(out) best can't be among the results and are let go."""
    from bisect import insort

    best, back, other = into.forward()
    end = len(into) - 1
    queue, out, made = [(0.0, 0, end, ())], [], 0  # loss against the best path, order, position, turns so far
    while queue and len(out) < n:
        loss, _, at, turns = queue.pop(0)
        out.append((best[end] - loss, turns))
        room = n - len(out)
        while at and room:
            straight = at - back[at]
            if len(queue) < room or loss + best[at] - other[at] < queue[-1][0]:
                for i, s, _ in into[at]:
                    if i == straight:
                        continue
                    more = loss + best[at] - best[i] - s
                    if len(queue) < room or more < queue[-1][0]:
                        made += 1
                        insort(queue, (more, made, i, ((at, i), turns)))
                        del queue[room:]
            at = straight
    return [(score, tuple(into.ids(turns))) for score, turns in out]


def words_of(text: str) -> list[str]:
    """Parts of a text (with the space mark in front) that no piece crosses."""
    import re

    return re.findall("▁+[^▁\n]*|[^▁\n]+|\n", SPACE + text.replace(" ", SPACE)) if text else []


def merge(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n largest sums of one value from each list (each in decreasing order),
    with the index taken from each list."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for values in lists:
        sums = sorted(((a + b, taken + (k,)) for a, taken in sums for k, b in enumerate(values)), key=lambda x: -x[0])[:n]
    return sums


class _Kept(dict):
    """What is made of words, up to some KEPT_BYTES; long words are made each time."""

    def __init__(self, make, most: int = KEPT_BYTES):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, w):
        out = self.make(w)
        if len(w) < SHORT:
            self.held += 400 + 12 * len(w)
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[w] = out
        return out


class Encoder:
    def __init__(self, pieces: Pieces, nbest: int = NBEST):
        self.pieces, self.nbest = pieces, nbest
        self.known = _Kept(self.word)
        self.ways = _Kept(self.losses, KEPT_BYTES // 8)

    def word(self, w: str) -> tuple[bytes, float, float]:
        """Ids as bytes, score, and what the second best path loses."""
        ids, score, loss = self.pieces.best_and_loss(w)
        return array("I", ids).tobytes(), score, loss

    def changes(self, text: str | None) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Ids of the best path as little-endian bytes; of each of the nbest best paths its
        score and where it differs from the best: (start, length, ids there), in bytes."""
        import numpy as np

        words = words_of(text or "")
        if not words:
            return b"", [(0.0, [])]
        ids, scores, losses = zip(*map(self.known.__getitem__, words))
        few = min(self.nbest - 1, len(words))
        close = sorted(np.argpartition(np.array(losses), few - 1)[:few].tolist()) if few else []
        ways = [self.ways[words[i]] for i in close]
        starts, at, before = [], 0, 0
        for i in close:
            at += sum(map(len, ids[before:i]))
            starts.append(at)
            before = i
        best, out = sum(scores), []
        for loss, taken in merge([[x for x, _ in way] for way in ways], self.nbest):
            turns = [(start, len(ids[i]), way[k][1]) for start, i, way, k in zip(starts, close, ways, taken) if way[k][1] != ids[i]]
            out.append((best + loss, turns))
        return b"".join(ids), out

    def encode(self, text: str | None):
        """(ids as little-endian bytes, the scores of the nbest best paths)."""
        paths = self.paths(text)
        return paths[0][1], [s for s, _ in paths]

    def paths(self, text: str | None) -> list[tuple[float, bytes]]:
        """(score, ids as little-endian bytes) of the nbest best paths."""
        best, all_of = self.changes(text)
        return [(score, _turned(best, turns)) for score, turns in all_of]

    def losses(self, w: str) -> list[tuple[float, bytes]]:
        """The nbest best paths of a word: score less the best, and ids."""
        found = search(self.pieces.edges(w), self.nbest)
        return [(s - found[0][0], array("I", ids).tobytes()) for s, ids in found]

    def nbest_ids(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The nbest best segmentations of a whole text, as ids."""
        out = [(0.0, ())]
        for w in words_of(text):
            found = search(self.pieces.edges(w), self.nbest)
            out = sorted(((a + s, ids + more) for a, ids in out for s, more in found), key=lambda x: -x[0])[: self.nbest]
        return out


def _turned(best: bytes, turns: list[tuple[int, int, bytes]]) -> bytes:
    """The best path's ids with those of the turns in their places."""
    parts, at = [], 0
    for start, length, ids in turns:
        parts += [best[at:start], ids]
        at = start + length
    return b"".join([*parts, best[at:]])


def _encode_batches(path: str | None, nbest: int):
    def run(batches):
        import gc

        import pyarrow as pa
        import public_tokenizers

        turn = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.binary())])
        kinds = (pa.binary(), pa.list_(pa.struct([("score", pa.float64()), ("turns", pa.list_(turn))])), pa.bool_())
        was = gc.isenabled()
        gc.disable()  # what is kept here holds no cycles, and the collector would visit it again and again
        try:
            encoder = Encoder(Pieces(path or public_tokenizers.path(MODEL)), nbest)
            for b in batches:
                rows, first, held = [], 0, 0
                for k, t in enumerate(b.column(1)):
                    text = t.as_py() or ""
                    best, paths = encoder.changes(text)
                    whole = (_turned(best, turns) for _, turns in paths)  # of a long text one path is held at a time
                    same = all(x == text for some in (([w] for w in whole) if len(best) > BATCH_BYTES else [list(whole)]) for x in encoder.pieces.decode_all(some))
                    rows.append((best, [{"score": s, "turns": [{"at": a, "length": n, "ids": x} for a, n, x in turns]} for s, turns in paths], same))
                    held += len(best)
                    if held > BATCH_BYTES or k == b.num_rows - 1:
                        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *columns], names=["doc_id", "best", "found", "round_trip"])
                        rows, first, held = [], k + 1, 0
        finally:
            if was:
                gc.enable()

    return run


def _decode_batches(path: str | None):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import public_tokenizers

        pieces = Pieces(path or public_tokenizers.path(MODEL))
        for b in batches:
            texts = [None if x.as_py() is None else pieces.decode(np.frombuffer(x.as_py(), "<u4").tolist()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None, nbest: int = NBEST) -> DataFrame:
    """Per row: paths, the nbest best segmentations, best first, each its score and
    its ids (little-endian, four bytes each); counts and digests of the best path's
    pieces, whether every path, decoded, gives the text back, and the scores of the
    best, second and last path (the first's where there are no others)."""
    schema = "doc_id long, best binary, found array<struct<score: double, turns: array<struct<at: int, length: int, ids: binary>>>>, round_trip boolean"
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode_batches(path, nbest), schema)
    best, n = F.col("best"), F.size("found")

    def whole(turns):
        """The best path's ids with those of the turns in their places; made only where paths are asked for."""
        step = lambda acc, t: F.struct((t["at"] + t["length"]).alias("at"), F.concat(acc["ids"], F.substring(best, acc["at"] + 1, t["at"] - acc["at"]), t["ids"]).alias("ids"))
        none = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("ids"))
        return F.aggregate(turns, none, step, lambda acc: F.concat(acc["ids"], F.substring(best, acc["at"] + 1, F.octet_length(best))))

    paths = F.transform("found", lambda p: F.struct(p["score"].alias("score"), whole(p["turns"]).alias("ids")))
    return found.select(
        "doc_id", paths.alias("paths"), (F.octet_length(best) / 4).cast("long").alias("n_pieces"), F.crc32(best).alias("ids_crc32"), "round_trip", n.cast("long").alias("n_paths"),
        F.col("found")[0]["score"].alias("best_score"), F.element_at("found", F.least(n, F.lit(2)))["score"].alias("second_score"), F.element_at("found", -1)["score"].alias("last_score"),
    )


def decode(encoded: DataFrame, path: str | None = None, rank: int = 0) -> DataFrame:
    """(doc_id, text) of every row of encode(): the text of its path of that rank, 0
    being the best; null where there are fewer paths."""
    ids = F.get("paths", F.lit(rank))["ids"]
    return encoded.select("doc_id", ids.alias("ids")).mapInArrow(_decode_batches(path), "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What encode() gives, with digests in the place of the paths: all scores and, as
    count:crc32 of its ids, every path."""
    digest = F.transform("paths", lambda p: F.concat_ws(":", (F.octet_length(p["ids"]) / 4).cast("long").cast("string"), F.crc32(p["ids"]).cast("string")))
    found = encode(table(spark, sf_dir, "documents"))
    return found.withColumns({"paths": F.array_join(digest, ","), "scores": F.array_join(F.transform("paths", lambda p: p["score"].cast("string")), ",")})
