"""The piece table of a SentencePiece model and its unigram lattice rules, shared by encoding and counting.

Rules: text is "▁" plus the text with spaces as "▁"; edges are the pieces of the table, plus an unknown edge for each
character that is no piece by itself, scored below every piece by PENALTY; the best path has the highest sum of scores;
of equal paths to a position the one whose last edge starts earliest stands. An unknown character becomes its UTF-8
bytes' pieces. No piece holds "▁" after another character, so a text falls into chunks, "▁"s followed by other
characters, that are solved apart. Scores are summed exactly, from zero at each chunk, where the library accumulates
32-bit floats over a whole text and so rounds away ties and differences late in long texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


@dataclass
class Table:
    """pieces: (piece, id, score) of the lattice; bytes: the ids of the 256 byte pieces; unknown: the score of an unknown edge."""

    pieces: list[tuple[str, int, float]]
    bytes: list[int]
    unknown: float
    texts: list[bytes]
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)
    _spelled: pa.Array | None = field(default=None, repr=False)

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_machine": None, "_spelled": None}

    def spelled(self) -> pa.Array:
        if self._spelled is None:
            self._spelled = pa.array(self.texts, pa.large_binary())
        return self._spelled

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            a = ahocorasick.Automaton()
            for piece, i, score in self.pieces:
                a.add_word(piece, (len(piece), score, i))
            a.make_automaton()
            self._machine = a
            self.single = {p for p, _, _ in self.pieces if len(p) == 1}
        return self._machine


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Table:
    """Read the table from a model file, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, at, texts, low = [], [0] * 256, [], 0.0
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            at[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"")
        else:
            pieces.append((piece, i, sp.get_score(i)))
            low = min(low, sp.get_score(i))
            texts.append(piece.encode())
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("a piece holds a space after another character: texts don't fall into chunks")
    return Table(pieces, at, low - PENALTY, texts)


def chunks(text: str | None) -> Iterator[str]:
    """The chunks of a text, one after another."""
    return map(re.Match.group, CHUNK.finditer(SPACE + text.replace(" ", SPACE))) if text else iter(())


def words(text: str | None) -> list[str]:
    """The chunks of a text, each without its first SPACE; between single spaces the built-in split finds them."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return [c[1:] for c in CHUNK.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def best(table: Table, chunk: str) -> tuple[list[float], list[int], list[int], list[int]]:
    """Viterbi by end position: score, piece count, start and id (or -1) of the last edge, for each prefix of chunk."""
    n = len(chunk)
    score, count, start, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    score[0] = 0.0
    machine, done = table.machine(), 0
    single, unknown = table.single, table.unknown

    def settle(upto: int) -> None:
        # unknown edges of the ends passed, considered after the pieces, that all start earlier
        nonlocal done
        while done < upto:
            c = chunk[done]
            if c not in single and score[done] + unknown > score[done + 1]:
                score[done + 1], count[done + 1], start[done + 1], ids[done + 1] = score[done] + unknown, count[done] + len(c.encode("utf-8", "surrogatepass")), done, -1
            done += 1

    known = single.issuperset(chunk)
    for end, (length, s, i) in machine.iter(chunk):  # longest first at every end
        if not known:
            settle(end)
        b = end + 1 - length
        if score[b] + s > score[end + 1]:
            score[end + 1], count[end + 1], start[end + 1], ids[end + 1] = score[b] + s, count[b] + 1, b, i
    if not known:
        settle(n)
    return score, count, start, ids


def encode_chunk(table: Table, chunk: str) -> list[int]:
    machine = table.machine()
    if table.single.issuperset(chunk):  # no unknown edges: `best` without the counts, an edge kept as the automaton's value
        score, edge = [0.0] + [float("-inf")] * len(chunk), [(1, 0.0, 0)] * (len(chunk) + 1)
        for end, found in machine.iter(chunk):
            length, s, _ = found
            end += 1
            s += score[end - length]
            if s > score[end]:
                score[end], edge[end] = s, found
        out, at = [], len(chunk)
        while at:
            length, _, i = edge[at]
            out.append(i)
            at -= length
        out.reverse()
        return out
    _, _, start, ids = best(table, chunk)
    out, at = [], len(chunk)
    while at:
        b = start[at]
        out.append([ids[at]] if ids[at] >= 0 else [table.bytes[x] for x in chunk[b:at].encode("utf-8", "surrogatepass")])
        at = b
    return [i for part in reversed(out) for i in part]


def decode_ids(table: Table, ids: list[int]) -> str:
    text = b"".join(map(table.texts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def decode_runs(table: Table, ids: pa.Array, ends: np.ndarray) -> list[str]:
    """decode_ids of every run of ids; ends: where each stops."""
    spelled = table.spelled().take(ids)
    at = np.frombuffer(spelled.buffers()[1], dtype=np.int64)[np.r_[0, ends]].tolist() if len(ids) else [0] * (len(ends) + 1)
    raw = memoryview(spelled.buffers()[2] or b"") if len(ids) else b""
    texts = (str(raw[a:b], "utf-8", "replace").replace(SPACE, " ") for a, b in zip(at, at[1:]))
    return [t[1:] if t.startswith(" ") else t for t in texts]
