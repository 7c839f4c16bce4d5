"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Each text is cut into stretches of STEPS bytes, all of which are read: one gated unit
reads a stretch from the left, one from the right; a softmax over both states
labels every position. A document's probabilities are the means over its letter
positions. Training is plain backpropagation through time with Adam on the driver, over a
bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import buffer_of
from docweave.llm.near_dup import chunks

STEPS = 64
HIDDEN = 6
#: The training sample: documents over all languages, and stretches of each.
SAMPLE_DOCS, SAMPLE_STRETCHES = 2000, 8
#: At most so many languages are learned, those of the most rows: the network has an output for each.
MOST_LANGS = 256
ROUNDS, BATCH, RATE = 250, 192, 0.03
LANES = 2048
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Gates in the tables: update, reset, candidate.
Params = dict[str, np.ndarray]


def fresh_params(classes: int, hidden: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    p = {}
    for side in "lr":
        p[f"x{side}"] = rng.normal(0, 0.3, (3 * hidden, 256))
        p[f"u{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
    p["out"] = rng.normal(0, 0.3, (classes, 2 * hidden))
    p["bias"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def states(x: np.ndarray, u: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (step, hidden, lane) of one unit reading codes (step, lane) in order."""
    h3, hidden = u.shape
    out = np.empty((len(codes), hidden, codes.shape[1]), np.float32)
    h = np.zeros((hidden, codes.shape[1]), np.float32)
    for t, c in enumerate(codes):
        g = x.take(c, axis=1)
        g[: 2 * hidden] += u[: 2 * hidden] @ h
        gates = sigmoid(g[: 2 * hidden])
        z, r = gates[:hidden], gates[hidden:]
        rh = r * h
        cand = g[2 * hidden :]
        cand += u[2 * hidden :] @ rh
        np.tanh(cand, out=cand)
        new = cand - h
        new *= z
        new += h
        if keep is not None:
            keep.append((h, z, r, rh, cand))
        h = out[t] = new
    return out


def probabilities(p: Params, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(class, lane) softmax of both states of one step."""
    hidden = left.shape[0]
    logit = p["out"][:, :hidden] @ left
    logit += p["out"][:, hidden:] @ right
    logit += p["bias"]
    logit -= logit.max(0)
    np.exp(logit, out=logit)
    logit /= logit.sum(0)
    return logit


def gradients(p: Params, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Params:
    """Gradients of the mean cross entropy over weighted positions, by backpropagation through time."""
    n = len(codes)
    kept: dict[str, list] = {"l": [], "r": []}
    left = states(p["xl"], p["ul"], codes, kept["l"])
    right = states(p["xr"], p["ur"], codes[::-1], kept["r"])[::-1]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    hidden = left.shape[1]
    down = np.empty((n, 2 * hidden, codes.shape[1]), np.float32)
    total = weight.sum() + 1e-6
    lanes = np.arange(codes.shape[1])
    for t in range(n):
        d = probabilities(p, left[t], right[t])
        d[target, lanes] -= 1
        d *= weight[t] / total
        grad["out"][:, :hidden] += d @ left[t].T
        grad["out"][:, hidden:] += d @ right[t].T
        grad["bias"] += d.sum(1, keepdims=True)
        down[t] = p["out"].T @ d
    for side, order in (("l", range(n - 1, -1, -1)), ("r", range(n))):
        u = p[f"u{side}"]
        back = np.zeros((hidden, codes.shape[1]), np.float32)
        part = slice(0, hidden) if side == "l" else slice(hidden, 2 * hidden)
        for t in order:
            h, z, r, rh, cand = kept[side][t if side == "l" else n - 1 - t]
            dh = down[t][part] + back
            dc = dh * z * (1 - cand * cand)
            drh = u[2 * hidden :].T @ dc
            dz = dh * (cand - h) * z * (1 - z)
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr, dc])
            grad[f"u{side}"][: 2 * hidden] += dg[: 2 * hidden] @ h.T
            grad[f"u{side}"][2 * hidden :] += dc @ rh.T
            onehot = np.zeros((codes.shape[1], 256), np.float32)
            onehot[lanes, codes[t]] = 1
            grad[f"x{side}"] += dg @ onehot
            back = dh * (1 - z) + drh * r + u[: 2 * hidden].T @ dg[: 2 * hidden]
    return grad


def trained(stretches: list[bytes], labels: np.ndarray, classes: int, hidden: int = HIDDEN, rounds: int = ROUNDS, seed: int = 7) -> Params:
    """Parameters fitted to labelled stretches of at most STEPS bytes."""
    p = fresh_params(classes, hidden, seed)
    rng = np.random.default_rng(seed)
    codes = np.full((len(stretches), STEPS), 32, np.uint8)
    for i, s in enumerate(stretches):
        codes[i, : len(s)] = np.frombuffer(s, np.uint8)
    one = {k: np.zeros_like(v) for k, v in p.items()}
    two = {k: np.zeros_like(v) for k, v in p.items()}
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(rows, max(1, BATCH // classes)) for rows in by_class if len(rows)])
        c = codes[pick].T.astype(np.int64)
        g = gradients(p, c, labels[pick], LETTER[c].astype(np.float32))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / rounds))
        for k in p:
            one[k] = 0.9 * one[k] + 0.1 * g[k]
            two[k] = 0.99 * two[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)
    return {k: v.astype(np.float32) for k, v in p.items()}


def pooled(p: Params, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sums of position probabilities and the label counts, over letter positions, by class."""
    classes, size = len(p["bias"]), np.diff(offsets)
    parts = -(-size // STEPS)
    doc = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][doc] + nth * STEPS
    n = np.minimum(STEPS, offsets[1:][doc] - start)
    wide = np.concatenate([buf, np.full(STEPS, 32, np.uint8)])
    total, count = np.zeros((len(size), classes)), np.zeros((len(size), classes), np.int64)
    for a in range(0, len(doc), LANES):
        s, m, d = start[a : a + LANES], n[a : a + LANES], doc[a : a + LANES]
        codes = wide[s[None, :] + np.arange(STEPS)[:, None]]
        codes[np.arange(STEPS)[:, None] >= m[None, :]] = 32
        letter = LETTER[codes].astype(np.float32)
        codes = codes.astype(np.intp)
        left = states(p["xl"], p["ul"], codes)
        right = states(p["xr"], p["ur"], codes[::-1])[::-1]
        soft, hard = np.zeros((classes, len(s)), np.float32), np.zeros((classes, len(s)), np.float32)
        for t in range(STEPS):
            q = probabilities(p, left[t], right[t])
            best = q == q.max(0)
            q *= letter[t]
            soft += q
            hard += best * letter[t]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        total[d[head]] += np.add.reduceat(soft.astype(np.float64), head, axis=1).T
        count[d[head]] += np.add.reduceat(hard.astype(np.int64), head, axis=1).T
    return total, count


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS, most_langs: int = MOST_LANGS) -> tuple[list[str], list[bytes], np.ndarray]:
    """The learned languages, and stretches of a sample of about `sample_docs` rows, 2 * `sample_docs` at most, the same share for each language.

    Languages are counted over all rows, and the `most_langs` most frequent ones are learned; the sample is taken by a hash of id and text, of rows that agree in both one.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return [], [], np.zeros(0, np.int64)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / len(langs) / counts[k])))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = lambda i: F.pmod(F.xxhash64(F.col(id_col).cast("string"), i), F.greatest(F.length(F.col(text_col)) - STEPS // 2, F.lit(1)))
    cut = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_STRETCHES)), lambda i: F.substring(F.col(text_col), place(i).cast("int") + 1, F.lit(STEPS)))
    # the order of rows must not matter for the result
    drawn = rows.select(F.col(lang_col).alias("lang"), draw.alias("draw"), cut.alias("parts")).where(F.col("draw") < share[F.col("lang")])
    sample = drawn.groupBy("lang", "draw").agg(F.min("parts").alias("parts")).orderBy("draw", "lang").limit(2 * sample_docs).collect()
    taken = sorted((r["lang"], s) for r in sample for s in r["parts"])
    return langs, [s.encode()[:STEPS] for _, s in taken], np.array([langs.index(k) for k, _ in taken], np.int64)


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, most_langs: int = MOST_LANGS) -> DataFrame:
    """Predict the language of every text of `docs` with a network trained on `training`.

    Returns the columns of `docs` and lang_pred, score (0 to 1: the mean probability of lang_pred over the
    letter positions) and shares (per learned language, in code point order, the share of letter positions labelled so).
    Null texts, texts without a letter, and every text if nothing was learned: `und`, 0.0, null. Input columns
    called as the three new ones are replaced. Repeated rows and rows of a null or repeated id are each labelled by their own text. Texts of any length are
    read whole, in stretches that begin anew, so no state crosses their borders. An empty table gives an empty result. Training rows
    without text, letter or language are left out; of rows that agree in id and text one is drawn. The network learns from about `sample_docs` rows, and the `most_langs` most
    frequent languages; texts of others get the name of one of these.
    """
    langs, stretches, labels = labelled_sample(training, id_col, text_col, lang_col, sample_docs, most_langs)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "shares", "__text")]
    ready = docs.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__text"))
    if not langs:
        return ready.drop("__text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "shares": F.lit(None).cast("array<double>")})
    params = trained(stretches, labels, len(langs))

    def run(batches):
        for t in chunks(batches, "__text"):
            total, count = pooled(params, *buffer_of(t.column("__text")))
            n = count.sum(1)
            some = n > 0
            best = total.argmax(1)
            score = np.where(some, total[np.arange(len(n)), best] / np.maximum(total.sum(1), 1e-9), 0.0)
            share = [(c / m).tolist() if m else None for c, m in zip(count, n, strict=True)]
            names = [langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
            out = t.drop_columns(["__text"])
            for name, col in (("lang_pred", pa.array(names, pa.string())), ("score", pa.array(np.round(score, 6))), ("shares", pa.array(share, pa.list_(pa.float64())))):
                out = out.append_column(name, col)
            yield from out.combine_chunks().to_batches()

    schema = ready.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "shares": F.lit(None).cast("array<double>")}).schema
    return ready.mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the predicted language of every document of `documents`."""
    from docweave.functions.session import spread, table

    docs = spread(table(spark, sf_dir, "documents"))
    out = identify(docs.select("doc_id", "text"), docs.where(~is_held_out()))
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "shares")
