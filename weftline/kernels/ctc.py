"""Viterbi decoding over frames: forced alignment of known tokens, and best path over an arc table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(-1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(-1, keepdims=True))


def forced(logp: np.ndarray, tokens: Sequence[int], blank: int = 0) -> list[tuple[int, int, float]]:
    """(first frame, end frame, mean probability) of each token, blanks between them allowed."""
    states = [blank]
    for t in tokens:
        states += [t, blank]
    n, frames = len(states), len(logp)
    if frames < len(tokens):
        raise ValueError("fewer frames than tokens")
    emit = logp[:, states]
    skip = np.array([k >= 2 and states[k] != blank and states[k] != states[k - 2] for k in range(n)])
    score = np.full(n, -np.inf)
    score[: min(2, n)] = emit[0, : min(2, n)]
    back = np.zeros((frames, n), np.int8)
    for t in range(1, frames):
        stay, one = score, np.concatenate([[-np.inf], score[:-1]])
        two = np.where(skip, np.concatenate([[-np.inf, -np.inf], score[:-2]])[:n], -np.inf)
        options = np.stack([stay, one, two])
        back[t] = options.argmax(0)
        score = options.max(0) + emit[t]
    at = n - 1 if n == 1 or score[n - 1] >= score[n - 2] else n - 2
    path = np.empty(frames, int)
    for t in range(frames - 1, -1, -1):
        path[t] = at
        at -= back[t, at]
    out = []
    for k in range(len(tokens)):
        at_frames = np.flatnonzero(path == 2 * k + 1)
        if not len(at_frames):
            out.append((0, 0, 0.0))
            continue
        out.append((int(at_frames[0]), int(at_frames[-1]) + 1, float(np.exp(logp[at_frames, tokens[k]]).mean())))
    return out


def best_path(logp: np.ndarray, arcs: Sequence[tuple[int, int, int, float]], final: int, blank: int = 0, beam: float = 25.0, direct: bool = False) -> tuple[list[tuple[int, int, int]], float]:
    """(frame, symbol, state) of the cheapest path from state 0 to `final` through arcs (src, dst, symbol, weight).

    Symbols below zero read no frame. A symbol may last several frames, blanks
    may stand anywhere, and partial paths more than `beam` over the best are dropped.
    A symbol follows another only after a blank, unless `direct` is set.
    """
    frames = len(logp)
    out_of: dict[int, list[tuple[int, int, float]]] = {}
    for src, dst, symbol, weight in arcs:
        out_of.setdefault(src, []).append((dst, symbol, weight))

    def spread(live: dict[tuple[int, int], tuple[float, tuple | None]]) -> None:
        todo = list(live)
        while todo:
            key = todo.pop()
            cost, trail = live[key]
            for dst, symbol, weight in out_of.get(key[0], ()):
                if symbol < 0:
                    new = (dst, blank)
                    if cost + weight < live.get(new, (np.inf, None))[0] - 1e-12:
                        live[new] = (cost + weight, ((-1, symbol, dst), trail))
                        todo.append(new)

    live: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, blank): (0.0, None)}
    spread(live)
    for t in range(frames):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(key: tuple[int, int], cost: float, step: tuple, trail: tuple | None, new=new) -> None:
            if cost < new.get(key, (np.inf, None))[0]:
                new[key] = (cost, (step, trail))

        for (state, last), (cost, trail) in live.items():
            offer((state, blank), cost - logp[t, blank], (t, blank, state), trail)
            if last != blank:
                offer((state, last), cost - logp[t, last], (t, last, state), trail)
            for dst, symbol, weight in out_of.get(state, ()):
                if symbol >= 0 and symbol != blank and (last == blank or (direct and symbol != last)):
                    offer((dst, symbol), cost + weight - logp[t, symbol], (t, symbol, dst), trail)
        spread(new)
        least = min((c for c, _ in new.values()), default=np.inf)
        live = {k: v for k, v in new.items() if v[0] <= least + beam}
    ends = [v for (state, _), v in live.items() if state == final]
    if not ends:
        return [], float("inf")
    cost, trail = min(ends, key=lambda v: v[0])
    out = []
    while trail is not None:
        out.append(trail[0])
        trail = trail[1]
    return out[::-1], float(cost)
