"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Tokens fall into classes whose number follows the vocabulary: the commonest tokens alone, the end of text alone, all
others by their last bytes. The model predicts a token's class from the two classes before it; within a class, smoothed
counts of the whole corpus take over. Class and counts together give every token a normalised probability.

Counts come from all training texts by a distributed count, of tokens and of three classes in a row. The triples are all
that the model can learn from; they lie in blocks dealt by a hash, so training depends on neither files nor partitions.
It is synchronised: in every round each block gives loss and gradient for the same parameters, with the expectation over
the noise taken exactly instead of drawn, and the driver takes one quasi-Newton step. For scoring, batched matrix
products give the normaliser of every pair of classes once; a token then costs one inner product. Common tokens carry
their counts into the tasks (a table of bounded size); the others are joined with the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import Cache, named
from tableloom.session import materialise

END = b""  # no word is empty


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words and one end."""
    return [*(text or b"").lower().split(), END]


@dataclass
class Classes:
    """Class of a token: its own for ``single`` tokens, else that of its ending, else the last class."""

    single: dict[bytes, int]
    endings: dict[bytes, int]
    size: int
    ending_bytes: int = 2

    def of(self, token: bytes) -> int:
        found = self.single.get(token)
        return self.endings.get(token[-self.ending_bytes :], self.size - 1) if found is None else found


@dataclass
class LogBilinear:
    """Scores of class w after classes u, v: (c0 * r[u] + c1 * r[v]) . q[w] + b[w]; r has one more row, before a text."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(share: np.ndarray, width: int, seed: int) -> LogBilinear:
        rng, k = np.random.default_rng(seed), len(share)
        small = 0.5 / np.sqrt(width)
        return LogBilinear(
            rng.normal(0, small, (k + 1, width)).astype(np.float32), np.ones((2, width), np.float32),
            rng.normal(0, small, (k, width)).astype(np.float32), np.log(share).astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> LogBilinear:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return LogBilinear(*(x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, cuts), self.parts())))

    def normaliser(self) -> np.ndarray:
        """log of the sum of exp(score) over all classes, for every pair of classes before."""
        out = np.empty((len(self.r), len(self.r)), np.float32)
        second = self.r * self.c[1]
        for u in range(len(self.r)):
            s = (self.r[u] * self.c[0] + second) @ self.q.T + self.b
            top = s.max(axis=1)
            out[u] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out


def add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``into[at] += rows`` with repeats, by sorting."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    starts = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    into[sorted_at[starts]] += np.add.reduceat(rows[order], starts, axis=0)


#: Noise classes per token.
NOISE = 24
#: Contexts whose scores are held at once.
CONTEXTS_AT_ONCE = 2048


def contrast(model: LogBilinear, share: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Loss of noise-contrastive estimation over counted triples, sorted by context, and its gradient, in one array.

    A context is u * (classes + 1) + v. Noise classes come in their shares, ``NOISE`` for each token, as expected.
    """
    k, log_noise, drawn = len(share), np.log(NOISE * share).astype(np.float32), (NOISE * share).astype(np.float32)
    loss, (gr, gc, gq, gb) = 0.0, (np.zeros(p.shape) for p in model.parts())
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    ends = np.r_[starts[1:], len(context)]
    for i in range(0, len(starts), CONTEXTS_AT_ONCE):
        first, last = starts[i], ends[min(i + CONTEXTS_AT_ONCE, len(starts)) - 1]
        own = starts[i : i + CONTEXTS_AT_ONCE]
        u, v = np.divmod(context[own], k + 1)
        row = np.repeat(np.arange(len(own)), ends[i : i + CONTEXTS_AT_ONCE] - own)
        w, count = word[first:last], n[first:last].astype(np.float32)
        total = np.bincount(row, n[first:last]).astype(np.float32)
        ru, rv = model.r[u], model.r[v]
        hidden = ru * model.c[0] + rv * model.c[1]
        scores = hidden @ model.q.T + (model.b - log_noise)
        np.clip(scores, -30, 30, out=scores)
        data = scores[row, w].astype(float)
        odds = np.exp(-scores)
        # -n log s(score) for what was seen, -(expected noise) log (1 - s(score)) for all classes
        loss += float((n[first:last] * np.log1p(np.exp(-data))).sum())
        loss += float((total @ (scores + np.log1p(odds))).astype(float) @ drawn.astype(float))
        slope = (total[:, None] / (1 + odds)) * drawn
        slope[row, w] -= count * (1 / (1 + np.exp(data))).astype(np.float32)
        gq += slope.T @ hidden
        gb += slope.sum(axis=0)
        gh = slope @ model.q
        add_rows(gr, np.concatenate([u, v]), np.concatenate([gh * model.c[0], gh * model.c[1]]))
        gc[0] += (gh * ru).sum(axis=0)
        gc[1] += (gh * rv).sum(axis=0)
    return np.concatenate([[loss], *(g.ravel() for g in (gr, gc, gq, gb))])


def minimise(loss_and_gradient, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps; a step that does not lower the loss is shortened."""
    value, gradient = loss_and_gradient(x)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if not np.abs(gradient).max(initial=0.0) > 1e-9:
            break
        way, used = -gradient, []
        for s, y in reversed(held):
            a = (s @ way) / (s @ y)
            used.append(a)
            way = way - a * y
        way = way * ((held[-1][0] @ held[-1][1]) / (held[-1][1] @ held[-1][1]) if held else 1 / np.linalg.norm(gradient))
        for (s, y), a in zip(held, reversed(used)):
            way = way + s * (a - (y @ way) / (s @ y))
        step = 1.0
        while True:
            there = x + step * way
            next_value, next_gradient = loss_and_gradient(there)
            if next_value <= value + 1e-4 * step * (gradient @ way):
                break
            step /= 4
            if step < 1e-5:
                return x
        s, y = there - x, next_gradient - gradient
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            held = [*held, (s, y)][-memory:]
        x, value, gradient = there, next_value, next_gradient
    return x


def contexts(classes: np.ndarray, lengths: Iterable[int], first: int) -> np.ndarray:
    """The two classes before each position; ``first`` stands before each text."""
    lengths = np.asarray(list(lengths), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    out = np.full((len(classes), 2), first, dtype=np.int32)
    out[1:, 1] = classes[:-1]
    out[2:, 0] = classes[:-2]
    out[starts] = first
    out[starts[lengths > 1] + 1, 0] = first
    return out


def count(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """(token, c, n): occurrences in training rows and in all rows; counted per task before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(train: Counter, other: Counter) -> pa.RecordBatch:
            keys = list(train.keys() | other.keys())
            own = [train[k] for k in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(own, pa.int64()),
                 pa.array([c + other[k] for k, c in zip(keys, own)], pa.int64())], names=["token", "c", "n"],
            )

        train, other = Counter(), Counter()
        for batch in batches:
            for t, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (train if t else other).update(tokens(text))
                if len(train) + len(other) >= limit:
                    yield flush(train, other)
                    train, other = Counter(), Counter()
        yield flush(train, other)

    rows = docs.mapInArrow(run, "token binary, c bigint, n bigint")
    return rows.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Count in training rows of the commonest tokens, at most ``most`` of them.

    A histogram of the counts in eighths of powers of two tells from where on they are few enough; tokens under that
    each hold less than 1 / ``most`` of all tokens.
    """
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    held = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, seen = None, 0
    for row in held:
        seen += row["count"]
        if seen > most:
            break
        least = row["step"]
    if least is None:
        return {}
    rows = counts.filter(step >= least).select("token", "c", "n").collect()
    return {bytes(r["token"]): r["c"] for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["token"])))}


def triple_blocks(rows: DataFrame, classes: Classes, block_triples: int = 250_000, limit: int = 500_000) -> DataFrame:
    """(block, context, word, n): the counted class triples of training rows, a packed row per block, in order.

    A context belongs to one block, by its hash; blocks are as many as the number of triples asks for.
    """
    k = classes.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Cache(classes.of, 100_000), [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys // k), pa.array(keys % k), pa.array(n, pa.int64())], names=["context", "word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                if not batch.column(1)[i].as_py():
                    continue
                words = tokens(batch.column(2)[i].as_py())
                word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                before = contexts(word, [len(words)], k).astype(np.int64)
                held.append((before[:, 0] * (k + 1) + before[:, 1]) * k + word)
                size += len(word)
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    schema = "context bigint, word bigint, n bigint"
    counted = rows.filter("train").mapInArrow(run, schema).groupBy("context", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    blocks = max(1, -(-counted.count() // block_triples))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("context", "ascending"), ("word", "ascending")])
        return pa.table({
            "block": group.column("block").slice(0, 1),
            **{c: pa.array([group.column(c).to_numpy().tobytes()], pa.binary()) for c in ("context", "word", "n")},
        })

    dealt = counted.withColumn("block", F.pmod(F.xxhash64("context"), F.lit(blocks)))
    return materialise(dealt.groupBy("block").applyInArrow(pack, "block bigint, context binary, word binary, n binary"))


def learn(blocks: DataFrame, begin: LogBilinear, share: np.ndarray, rounds: int, ridge: float, lanes: int = 64) -> LogBilinear:
    """Synchronised rounds over all blocks. Gradients are added up in the order of the blocks."""
    n_blocks = blocks.count()
    if not n_blocks:
        return begin
    def evaluate(flat: np.ndarray) -> np.ndarray:
        model = begin.filled(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    made = contrast(model, share, *(np.frombuffer(part, np.int64) for part in parts))
                    made = np.append(made, np.frombuffer(parts[2], np.int64).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([made.tobytes()], pa.binary())], names=["block", "v"])

        parts = blocks.mapInArrow(run, "block bigint, v binary")
        if n_blocks > lanes:  # fewer rows for the driver

            def added(group: pa.Table) -> pa.Table:
                group = group.sort_by("block")
                total = sum(np.frombuffer(v) for v in group.column("v").to_pylist())
                return pa.table({"block": group.column("block").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

            parts = parts.groupBy(F.col("block") % lanes).applyInArrow(added, "block bigint, v binary")
        return sum(np.frombuffer(r["v"]) for r in sorted(parts.collect(), key=lambda r: r["block"]))

    def loss_and_gradient(flat: np.ndarray) -> tuple[float, np.ndarray]:
        made = evaluate(flat)
        n = made[-1]
        return float(made[0] / n + ridge * (flat @ flat) / (2 * n)), made[1:-1] / n + ridge * flat / n

    return begin.filled(minimise(loss_and_gradient, begin.flat(), rounds))


def score(
    docs: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    singles: int | None = None,
    endings: int | None = None,
    width: int = 16,
    common: int = 131_072,
    rounds: int = 40,
    ridge: float = 3.0,
    seed: int = 5,
) -> DataFrame:
    """Per document: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score; whole texts.

    Learns from rows where ``train`` holds; a null there means held out. ``base_score`` adds log10((c + 1) / (N + V + 1))
    over the tokens; ``score`` the model's log10 probabilities. ``singles`` and ``endings`` (classes of one token, and of
    tokens with an ending in common) follow the cube root of the vocabulary unless given. A null text counts as empty and has one token, its end.
    Repeated rows are scored, and learnt from, each. Without training rows all base scores are 0 and the model knows one
    class. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        named(key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), named(text).cast("binary").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    spark = docs.sparkSession
    counts = materialise(count(rows))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_all, v_all = sums["n"], sums["v"]
    following = max(16, round(1.5 * v_all ** (1 / 3)))
    singles, endings = (following if size is None else size for size in (singles, endings))

    # tables of bounded size for the tasks: common tokens, single tokens, endings, sums of the classes
    top = commonest(counts, common)
    end = counts.filter(F.length("token") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    alone = counts.filter((F.length("token") > 0) & (F.col("c") > 0)).orderBy(F.desc("c"), "token").limit(singles)
    heavy = [(END, end), *((bytes(r["token"]), r["c"]) for r in alone.select("token", "c").collect())]
    single = {token: i for i, (token, _) in enumerate(heavy)}
    rest = counts.filter(~F.col("token").isin(*map(F.lit, map(bytearray, single))) & (F.col("c") > 0))
    tail = F.substring("token", -2, 2)
    tail = F.when(F.length("token") < 2, F.col("token")).otherwise(tail)
    by_ending = rest.groupBy(tail.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    best = by_ending.orderBy(F.desc("c"), "e").limit(endings).collect()
    classes = Classes(single, {bytes(r["e"]): len(single) + i for i, r in enumerate(best)}, len(single) + len(best) + 1)
    mass, kinds = np.zeros(classes.size), np.zeros(classes.size)
    mass[: len(heavy)] = [c for _, c in heavy]
    for r in best:
        at = classes.endings[bytes(r["e"])]
        mass[at], kinds[at] = r["c"], r["v"]
    mass[-1], kinds[-1] = max(0, n_all - mass.sum()), max(0, v_all - kinds.sum() - sum(c > 0 for _, c in heavy))
    share = (mass + 1) / (mass + 1).sum()
    within = np.log10(mass + kinds + 1)  # of a class that holds several tokens
    within[: len(heavy)] = np.log10(mass[: len(heavy)] + 1)
    common_log = {t: float(np.log10(c + 1)) for t, c in top.items()}
    begin = LogBilinear.start(share, width, seed)

    model = learn(triple_blocks(rows, classes), begin, share, rounds, ridge)
    shared = spark.sparkContext.broadcast((model, model.normaliser(), common_log))
    ten = np.log(10.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, normal, logs = shared.value
        number = {t: i for i, t in enumerate(logs)}
        log_of = np.fromiter(logs.values(), float, len(logs))
        class_of = np.fromiter(map(classes.of, logs), np.int32, len(logs))

        known = Cache(lambda t: number[t] if t in number else -1 - classes.of(t), 200_000)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            totals, counted, base, found, rare = [], [], [], [], []
            for value in texts:
                words = tokens(value)
                codes = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                common_at = codes >= 0
                word = np.where(common_at, class_of[np.maximum(codes, 0)], -1 - codes) if len(log_of) else -1 - codes
                before = contexts(word, [len(words)], classes.size)
                hidden = m.r[before[:, 0]] * m.c[0] + m.r[before[:, 1]] * m.c[1]
                raw = np.einsum("ij,ij->i", hidden, m.q[word]) + m.b[word] - normal[before[:, 0], before[:, 1]]
                own = log_of[codes[common_at]]
                totals.append(float(raw.sum(dtype=float) / ten - within[word].sum()))
                counted.append(len(words))
                base.append(float(own.sum()))
                found.append(int((own > 0).sum()))
                rare.append([words[i] for i in np.flatnonzero(~common_at)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counted, pa.int64()),
                 pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(totals, pa.float64()),
                 pa.array(rare, pa.list_(pa.binary()))],
                names=["row", "id", "train", "n_tokens", "n_known", "logs", "total", "rare"],
            )

    judged = materialise(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "train", "text").mapInArrow(
            judge,
            f"row bigint, id {kind}, train boolean, n_tokens bigint, n_known bigint, logs double, total double,"
            " rare array<binary>",
        )
    )
    # tokens outside the common table; each is a small part of all tokens, so no key of this join is hot
    more = (
        judged.select("row", F.explode("rare").alias("token"))
        .join(counts.filter("c > 0").select("token", "c"), "token")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("c") + 1)).alias("more_logs"), F.count(F.lit(1)).alias("more_known"))
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return judged.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(key),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("total") + logs).alias("score"),
    )
