"""A small decoder in NumPy for readings that need a forward pass; runs in ``mapInPandas``, weights travel with the function.

Embedding, pre-RMSNorm, rotary positions (halves), causal attention, gated MLP, tied head; float64 throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import PATTERNS, mlp_width

#: Tokens of sequences that go through the decoder at once.
TOKENS = 1 << 12


@dataclass
class Model:
    """M1: weights of a decoder."""

    embed: np.ndarray
    layers: list[dict[str, np.ndarray]]
    norm: np.ndarray
    heads: int


def random_model(vocabulary: int, d: int, heads: int, layers: int, seed: int) -> Model:
    """An untrained model, the control of every reading."""
    g = np.random.default_rng(seed)
    w = lambda *s: g.normal(0, 0.02, s)
    f = mlp_width(d)
    make = lambda: {"q": w(d, d), "k": w(d, d), "v": w(d, d), "o": w(d, d), "gate": w(d, f), "up": w(d, f), "down": w(f, d), "n1": np.ones(d), "n2": np.ones(d)}
    return Model(w(vocabulary, d), [make() for _ in range(layers)], np.ones(d), heads)


def _norm(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-6) * w


def _rotate(x: np.ndarray) -> np.ndarray:
    n, size = x.shape[-2], x.shape[-1]
    angle = np.arange(n)[:, None] * 10000.0 ** (-np.arange(0, size, 2) / size)
    a, b = x[..., : size // 2], x[..., size // 2 :]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], -1)


def _run(m: Model, x: np.ndarray, first: int = 0, intervene: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, list, list, list]:
    """The layers from ``first`` on, for x [..., n, d]: the last norm's output, attention, outputs of the heads and inputs by layer."""
    maps, outs, inputs = [], [], []
    n, size = x.shape[-2], m.embed.shape[1] // m.heads
    hide = np.triu(np.full((n, n), -np.inf), 1)
    for i, w in list(enumerate(m.layers))[first:]:
        inputs.append(x)
        h = _norm(x, w["n1"]).reshape(-1, x.shape[-1])  # rows of all sequences: one product instead of one for each
        q, k, v = ((h @ w[c]).reshape(*x.shape[:-1], m.heads, size).swapaxes(-3, -2) for c in "qkv")
        s = _rotate(q) @ _rotate(k).swapaxes(-2, -1) / np.sqrt(size) + hide
        a = np.exp(s - s.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        o = a @ v
        o = intervene(i, o) if intervene else o
        maps.append(a)
        outs.append(o)
        x = x + (o.swapaxes(-3, -2).reshape(h.shape) @ w["o"]).reshape(x.shape)
        h = _norm(x, w["n2"]).reshape(h.shape)
        g = h @ w["gate"]
        x = x + ((g / (1 + np.exp(-g)) * (h @ w["up"])) @ w["down"]).reshape(x.shape)
    return _norm(x, m.norm), maps, outs, inputs


def forward(m: Model, ids: np.ndarray, intervene: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Logits [n, V], attention [layers, heads, n, n], outputs of the heads [heads, n, size] by layer.

    M2: all are captured. M5: ``intervene(layer, outputs)`` may replace the heads' outputs (mean ablation, patching).
    Ids may be [sequences, n]; logits and outputs then begin with the sequences, and so does each layer's attention.
    """
    x, maps, outs, _ = _run(m, m.embed[ids], 0, intervene)
    return x @ m.embed.T, np.stack(maps), outs


def _alike(pdf: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    """(seq, ids [sequences, n] of each column) of the sequences of one length, about ``TOKENS`` at a time."""
    size = pdf[columns[0]].str.len().to_numpy()
    for n in np.unique(size):
        at, step = np.flatnonzero(size == n), max(TOKENS // max(int(n), 1), 1)
        for i in range(0, len(at), step):
            few = pdf.iloc[at[i : i + step]]
            yield few["seq"].to_numpy(), *[np.stack(few[c].to_numpy()).astype(np.int64) for c in columns]


def _losses(seq: np.ndarray, ids: np.ndarray, z: np.ndarray) -> pd.DataFrame:
    """(seq, pos, nll, exact) from the ids and logits of sequences of one length."""
    z, to = z[:, :-1], ids[:, 1:]
    top = z.max(-1)
    nll = top + np.log(np.exp(z - top[..., None]).sum(-1)) - np.take_along_axis(z, to[..., None], -1)[..., 0]
    return pd.DataFrame({"seq": np.repeat(seq, nll.shape[1]), "pos": np.tile(np.arange(nll.shape[1]), len(seq)), "nll": nll.ravel(), "exact": (z.argmax(-1) == to).ravel()})


def nll_rows(m: Model):
    """M3: rows (seq, pos, nll, exact) of a table (seq, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seq, ids in _alike(pdf, "ids"):
                yield _losses(seq, ids, forward(m, ids)[0])

    return run


def token_losses(sequences: DataFrame, m: Model) -> DataFrame:
    return sequences.mapInPandas(nll_rows(m), "seq long, pos long, nll double, exact boolean")


def attention_rows(sequences: DataFrame, m: Model) -> DataFrame:
    """(seq, layer, head, q, k, w) of the lower triangle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seq, ids in _alike(pdf, "ids"):
                q, k = np.tril_indices(ids.shape[1])
                for layer, a in enumerate(_run(m, m.embed[ids])[1]):
                    for head in range(a.shape[1]):
                        yield pd.DataFrame({"seq": np.repeat(seq, len(q)), "layer": layer, "head": head, "q": np.tile(q, len(seq)), "k": np.tile(k, len(seq)), "w": a[:, head, q, k].ravel()})

    return sequences.mapInPandas(run, "seq long, layer long, head long, q long, k long, w double")


def attention_means(sequences: DataFrame, m: Model, repeat: int) -> DataFrame:
    """What ``pair_means`` makes of ``attention_rows``, a row per sequence, layer and head: weights are averaged where
    they arise, so that pairs of positions are neither handed over nor shuffled. ``seq`` is different in all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seq, ids in _alike(pdf, "ids"):
                q, k = np.tril_indices(ids.shape[1])
                on = {name: np.flatnonzero(p(q, k, repeat)) for name, p in PATTERNS.items()}
                for layer, a in enumerate(_run(m, m.embed[ids])[1]):
                    w = a[:, :, q, k]
                    means = {name: w[..., at].mean(-1).ravel() if len(at) else None for name, at in on.items()}
                    yield pd.DataFrame({"seq": np.repeat(seq, m.heads), "layer": layer, "head": np.tile(np.arange(m.heads), len(seq)), **means})

    return sequences.mapInPandas(run, "seq long, layer long, head long, " + ", ".join(f"{name} double" for name in PATTERNS))


def ablated_losses(sequences: DataFrame, m: Model, heads: list[tuple[int, int]], means: dict[tuple[int, int], np.ndarray] | None = None) -> DataFrame:
    """M5, M7: losses with the outputs of some heads replaced by their mean (default: zero)."""

    def swap(layer: int, o: np.ndarray) -> np.ndarray:
        o = o.copy()
        for at, head in heads:
            if at == layer:
                o[..., head, :, :] = (means or {}).get((at, head), 0.0)
        return o

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seq, ids in _alike(pdf, "ids"):
                yield _losses(seq, ids, forward(m, ids, swap)[0])

    return sequences.mapInPandas(run, "seq long, pos long, nll double, exact boolean")


def patched_rows(pairs: DataFrame, m: Model, heads: list[tuple[int, int]], repeat: int) -> DataFrame:
    """M6: logit differences (right minus wrong, mean over positions) of the clean, corrupt and patched runs of each head.

    ``pairs``: seq, clean, corrupt (ids of one length). Patching puts a head's output of the clean run into the corrupt one, which
    goes on from that layer; only the logits that are read are formed.
    """

    def reading(x: np.ndarray, clean: np.ndarray, corrupt: np.ndarray) -> np.ndarray:
        at = np.arange(repeat, 2 * repeat - 1)
        return (x[:, at] * (m.embed[clean[:, at + 1]] - m.embed[corrupt[:, at + 1 - repeat]])).sum(-1).mean(-1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seq, a, b in _alike(pdf, "clean", "corrupt"):
                x, _, outs, _ = _run(m, m.embed[a])
                y, _, _, inputs = _run(m, m.embed[b])
                clean, corrupt = reading(x, a, b), reading(y, a, b)
                for layer, head in heads:

                    def put(i: int, o: np.ndarray, layer=layer, head=head, outs=outs) -> np.ndarray:
                        if i == layer:
                            o = o.copy()
                            o[:, head] = outs[layer][:, head]
                        return o

                    yield pd.DataFrame({"seq": seq, "layer": layer, "head": head, "clean": clean, "corrupt": corrupt, "patched": reading(_run(m, inputs[layer], layer, put)[0], a, b)})

    return pairs.mapInPandas(run, "seq long, layer long, head long, clean double, corrupt double, patched double")


def _ov(gram: np.ndarray, m: Model, layer: int, head: int) -> float:
    w, size = m.layers[layer], m.embed.shape[1] // m.heads
    s = slice(head * size, (head + 1) * size)
    e = np.linalg.eigvals(w["o"][s] @ (m.norm[:, None] * gram * w["n1"]) @ w["v"][:, s])
    total = np.abs(e).sum()
    return float(e.real.sum() / total) if total else float("nan")


def ov_copying(m: Model) -> list[tuple[int, int, float]]:
    """M4: sum of real parts over sum of absolute values of the eigenvalues of each head's token-to-token circuit.

    The circuit E P O E' has the eigenvalues of the small product P O E' E, so no vocabulary-sized matrix is built.
    """
    gram = m.embed.T @ m.embed
    return [(layer, head, _ov(gram, m, layer, head)) for layer in range(len(m.layers)) for head in range(m.heads)]


def gram(vectors: DataFrame, column: str) -> DataFrame:
    """M4: (i, j, g): the sums over all vectors of the products of two dimensions; batches are summed before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column].to_numpy()).astype(float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    return vectors.select(column).filter(F.col(column).isNotNull()).mapInPandas(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def ov_scores(products: DataFrame, m: Model) -> DataFrame:
    """M4: (layer, head, score) from the products of an embedding of any size; only the square of the width is gathered."""
    size = m.embed.shape[1]
    g = np.zeros((size, size))
    for r in products.collect():
        g[r["i"], r["j"]] = r["g"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=[_ov(g, m, layer, head) for layer, head in zip(pdf["layer"], pdf["head"], strict=True)])

    heads = products.sparkSession.range(len(m.layers) * m.heads).selectExpr(f"id div {m.heads} AS layer", f"id % {m.heads} AS head")
    return heads.mapInPandas(run, "layer long, head long, score double")
