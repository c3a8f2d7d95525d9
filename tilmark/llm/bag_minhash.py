"""BagMinHash: signatures whose components agree with probability equal to the weighted Jaccard similarity.

A weight is discretised at the integers. Its range is covered by dyadic intervals (0,1], (1,2], (2,4], (4,8], ...
An element is the root of one Poisson process per interval that its weight reaches; the rate of a process is its
interval's length, each point goes to a random signature component and to one unit of weight, uniform over the
interval (the bits of that draw are the halves it goes down through), and counts when the element's weight reaches that unit. All draws are hashes of the
element, the interval and the point's number, so equal units of equal elements make equal points in every text.
A component is the earliest point that it gets. Processes stop once they pass the latest component.
"""

from __future__ import annotations

import numpy as np

from tilmark.llm.textvec import U, mix

SIZE = 150
ROUND_POINTS = 100_000
_STEP, _INTERVAL = U(0xD1342543DE82EF95), U(0xA0761D6478BD642F)
_SCALE = 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * _SCALE


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Signatures of n bags: row i of the result is the signature of the elements whose owner is i.

    owner, element and weight (at least 1) have one entry for each distinct element of each bag. An empty bag
    has a signature of infinities. Components are arrival times: two are equal only if they are the same point."""
    out = np.full(n * size, np.inf)
    if not len(owner):
        return out.reshape(n, size)
    parts = [(owner, mix(element), np.ones(len(owner)), np.zeros(len(owner)), weight)]
    k, reach = 1, 1
    while (inside := weight > reach).any():
        with np.errstate(over="ignore"):
            root = mix(element[inside] + U(k) * _INTERVAL)
        parts.append((owner[inside], root, np.full(inside.sum(), float(reach)), np.full(inside.sum(), float(reach)), weight[inside]))
        k, reach = k + 1, reach * 2
    owner, root, length, low, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, number = np.zeros(len(owner)), 0
    while len(owner):
        width = 1 if number < 4 else max(1, min(16, ROUND_POINTS // len(owner)))  # points drawn for each process in this round
        with np.errstate(over="ignore"):
            draw = mix(root[:, None] + (np.arange(number + 1, number + width + 1).astype(U) * _STEP)[None, :])
            when = time[:, None] + np.cumsum(-np.log(_uniform(draw)) / (length[:, None] * size), axis=1)
            where = mix(draw + _INTERVAL)
            unit = low[:, None] + np.ceil(_uniform(mix(where + _STEP)) * length[:, None])
        counts = unit <= weight[:, None]
        at = owner[:, None] * size + ((where >> U(32)) * U(size) >> U(32)).astype(np.int64)
        np.minimum.at(out, at[counts], when[counts])
        time, number = when[:, -1], number + width
        last = out.reshape(n, size).max(axis=1)
        going = time < last[owner]
        owner, root, length, low, weight, time = (x[going] for x in (owner, root, length, low, weight, time))
    return out.reshape(n, size)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of the bands of `rows` components each, one column per band; bands of different places differ."""
    n, size = signature.shape
    count = size // rows
    bits = mix(signature.view(U))[:, : count * rows].reshape(n, count, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, count + 1).astype(U) * _STEP, (n, count)).copy()
        for j in range(rows):
            h = mix(h * _INTERVAL + bits[:, :, j])
    return h.view(np.int64)
