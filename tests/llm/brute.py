"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(256)).lower()


def words(text) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def shingles(text, width: int = 5) -> set:
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_components(rows, percent: int = 75) -> dict:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {i: (len(sets[i]), least.get(find(i))) for i in range(len(rows))}


def repeats(texts, length: int) -> list[list[tuple[int, int]]]:
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        covered = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                covered[p : p + length] = b"\1" * length
        out.append([m.span() for m in re.finditer(b"\1+", bytes(covered))])
    return out


def best_pieces(texts, path: str) -> list[list[int]]:
    """Ids of each text's best segmentation, straight from the model file: all pieces at every place, over the whole text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
    plain = [i for i in range(model.get_piece_size()) if not any(test(i) for test in (model.is_byte, model.is_control, model.is_unknown, model.is_unused))]
    score = [float(np.float32(-math.log(rank + 2))) for rank in range(len(plain))]
    by_head: dict = {}
    for i, value in zip(plain, score, strict=True):
        piece = model.id_to_piece(i).replace("\u2581", " ")
        by_head.setdefault(piece[0], []).append((piece, i, value))
    odd = float(np.float32(min(score) - 10))
    found = []
    for text in texts:
        line = f" {text}" if text else ""
        best: list = [(0.0, None)] + [(-math.inf, None)] * len(line)  # of every prefix: score, (start, ids)
        for at, char in enumerate(line):
            steps = [(p, [i], v) for p, i, v in by_head.get(char, []) if line.startswith(p, at)]
            if not any(len(p) == 1 for p, _, _ in steps):
                steps.append((char, [byte[b] for b in char.encode("utf-8", "surrogatepass")], odd))
            for piece, ids, value in steps:
                if best[at][0] + value > best[at + len(piece)][0]:
                    best[at + len(piece)] = (best[at][0] + value, (at, ids))
        out, end = [], len(line)
        while end:
            end, ids = best[end][1]
            out = ids + out
        found.append(out)
    return found
