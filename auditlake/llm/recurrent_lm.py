"""Gated recurrent language model with a class-factored output, scored over complete documents.

Words are counted over all training documents. The most frequent ones are the model's own: sorted by count and cut
into classes, so a word's probability is that of its class times that of the word in its class, both a softmax of
the state. One more class stands for the end, and one for each kind of ending of the other words; their probability
within their class comes from their counts, plus one, as in the base score. The recurrent layer is trained with truncated
backpropagation: first on a bounded number of training documents, then on every training document, dealt into rounds
of shards of a bounded size. After a round the shards' weights are averaged, and the next round goes on from there;
rounds grow as the logarithm of the corpus, shards in proportion to it. In training and scoring the state is carried
from window to window to the document's end.

Counts of the most frequent words are sent to the tasks (``SENT``); other words meet their counts in a join.

Cases: NULL, empty and blank texts have one token, the end. A NULL doc_id is not held out. Without training documents
the base is 0 and the model's words are all unknown. Repeated rows are scored each. Other columns aren't looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.labelled import held_out
from auditlake.llm.shared import cut, table

FOLDS, HELD_OUT = 7, 2
OWN, PER_CLASS = 1024, 32
CLASSES = OWN // PER_CLASS
ENDINGS, ENDING_BYTES = 64, 3
SENT = 200_000
STATE, EMBEDDING, WINDOW = 32, 16, 16
GROUP, STREAMS = 1024, 128
START_ROWS, SHARD_TOKENS = 500, 1_000_000
FLUSH = 400_000
_LEAST = 1e-30
_BEGIN = OWN + ENDINGS
_COUNTS = "word binary, train bigint, total bigint"


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case; split() of bytes parts them at space and \\t..\\r."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words; the end is the NULL word."""
    train, total = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        found = list(total)
        columns = {"word": pa.array(found, pa.binary()), "train": [train[w] for w in found]}
        return pa.RecordBatch.from_pydict(columns | {"total": pa.array(total.values(), pa.int64())})

    for batch in batches:
        for text, held in zip(words.text_column(batch), batch.column("held_out").to_pylist(), strict=True):
            found = tokens(text.as_py())
            total.update(found)
            total[None] += 1
            if not held:
                train.update(found)
                train[None] += 1
            if len(total) > FLUSH:
                yield flush()
                train, total = Counter(), Counter()
    if total:
        yield flush()


@dataclass
class Vocabulary:
    """Counts of the words that tasks know, the model's own words by rank, and sums over all training tokens."""

    counts: dict[bytes, int]
    rank: dict[bytes, int]
    own_counts: np.ndarray
    other_counts: np.ndarray
    other_words: np.ndarray
    ends: int
    train_tokens: int
    train_words: int

    @property
    def base(self) -> float:
        return float(np.log10(self.train_tokens + self.train_words + 1))

    @property
    def other(self) -> np.ndarray:
        """For each ending, the logarithm of what its words' counts, plus one, sum to; an unknown word is one of them."""
        return np.log10(self.other_counts + self.other_words + 1.0)


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def _softmax(scores: np.ndarray, chosen: np.ndarray, columns: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithm of the chosen row's share in each column, and the slopes of the loss if ``learn``; ``scores`` are overwritten."""
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    total = scores.sum(axis=0)
    result = np.log(np.maximum(scores[chosen, columns] / total, _LEAST))
    if not learn:
        return result, None
    scores /= total
    scores[chosen, columns] -= 1
    return result, scores


class Model:
    """Weights and their training. Inputs are ranks, endings of other words, or the beginning."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        random = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) * 0.1).astype(np.float32)

        padded = np.zeros(OWN)
        padded[: len(vocabulary.own_counts)] = vocabulary.own_counts
        by_class = padded.reshape(CLASSES, PER_CLASS)
        mass = np.concatenate((by_class.sum(axis=1), [vocabulary.ends], vocabulary.other_counts)) + 0.5
        slots = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -20.0)
        slots -= np.log(np.exp(slots).sum(axis=1, keepdims=True))
        self.weights = {
            "embedding": normal(_BEGIN + 1, EMBEDDING),
            "inward": normal(EMBEDDING, 3 * STATE) * 3,
            "inward_bias": np.zeros(3 * STATE, dtype=np.float32),
            "across": normal(STATE, 3 * STATE) * 2,
            "class": np.zeros((STATE, CLASSES + 1 + ENDINGS), dtype=np.float32),
            "class_bias": np.log(mass / mass.sum()).astype(np.float32),
            "word": np.zeros((CLASSES, STATE, PER_CLASS), dtype=np.float32),
            "word_bias": slots.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates and the next state, from projected inputs and a state."""
        a = h @ self.weights["across"]
        gates = x[:, : 2 * STATE] + a[:, : 2 * STATE]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = gates[:, STATE:] * a[:, 2 * STATE :]
        new += x[:, 2 * STATE :]
        np.tanh(new, out=new)
        return gates, a[:, 2 * STATE :], new, new + gates[:, :STATE] * (h - new)

    def output(self, h: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
        """Log-probability of each target given its state; slopes of the loss if ``learn``."""
        w = self.weights
        kind = np.where(target < OWN, target // PER_CLASS, target - OWN + CLASSES)
        rows = np.arange(len(kind))
        # one column for each target, so that what runs over classes runs over whole rows of memory
        scores = w["class"].T @ h.T
        scores += w["class_bias"][:, None]
        result, off = _softmax(scores, kind, rows, learn)
        slope, slopes = None, {}
        if learn:
            slope = w["class"] @ off
            slopes = {"class": (off @ h).T, "class_bias": off.sum(axis=1)}
            slopes |= {"word": np.zeros_like(w["word"]), "word_bias": np.zeros_like(w["word_bias"])}
        order = np.argsort(kind.astype(np.int16), kind="stable")  # few values are sorted by counting
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        own = order[: cuts[-1]]
        parts = [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
        state, scores = np.ascontiguousarray(h[own].T), np.empty((PER_CLASS, len(own)), dtype=np.float32)
        for c, begin, end in parts:
            scores[:, begin:end] = w["word"][c].T @ state[:, begin:end]
        scores += w["word_bias"].T[:, kind[own]]
        found, off = _softmax(scores, target[own] % PER_CLASS, rows[: len(own)], learn)
        result[own] += found
        if learn:
            back = np.empty_like(state)
            for c, begin, end in parts:
                back[:, begin:end] = w["word"][c] @ off[:, begin:end]
                slopes["word"][c] = state[:, begin:end] @ off[:, begin:end].T
                slopes["word_bias"][c] = off[:, begin:end].sum(axis=1)
            slope[:, own] += back
        return result, None if slope is None else slope.T, slopes

    def read(self, ids: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each document, given as targets (ranks, OWN for the end, OWN + 1 + ending).

        Documents of like length are read side by side, window by window; the state goes from window to window.
        """
        result = np.zeros(len(ids))
        order = np.argsort([-len(d) for d in ids], kind="stable")
        projected = self.weights["embedding"] @ self.weights["inward"] + self.weights["inward_bias"]
        for begin in range(0, len(ids), GROUP):
            group = order[begin : begin + GROUP]
            lengths = np.array([len(ids[k]) for k in group])
            starts = np.cumsum([0, *lengths[:-1]])
            flat = np.concatenate([ids[k] for k in group])
            state = np.zeros((len(group), STATE), dtype=np.float32)
            previous = np.full(len(group), _BEGIN, dtype=np.int32)
            for window in range(0, lengths[0], WINDOW):
                n = int(np.searchsorted(-lengths, -window, side="left"))
                state, previous = state[:n], previous[:n]
                targets, states, owners = [], [], []
                for t in range(window, min(window + WINDOW, lengths[0])):
                    active = int(np.searchsorted(-lengths, -t, side="left"))
                    after = self.step(projected[previous[:active]], state[:active])[-1]
                    state[:active] = after
                    target = flat[starts[:active] + t]
                    previous[:active] = target - (target >= OWN)
                    states.append(after)
                    targets.append(target)
                    owners.append(group[:active])
                found, *_ = self.output(np.concatenate(states), np.concatenate(targets), False)
                result += np.bincount(np.concatenate(owners), weights=found, minlength=len(ids))
        return result

    def learn(self, ids: list[np.ndarray], rate: float, memory: dict) -> None:
        """One pass of truncated backpropagation over documents, laid out in ``STREAMS`` streams side by side.

        The state goes from window to window and begins anew with a document; after every window the weights take an
        adaptive step.
        """
        total = sum(map(len, ids))
        flat = np.concatenate(ids)
        starts = np.zeros(total, dtype=bool)
        starts[np.cumsum([0, *map(len, ids)])[:-1]] = True
        steps = -(-total // STREAMS)
        place = np.minimum(np.arange(STREAMS) * steps + np.arange(steps)[:, None], total - 1)
        block, fresh = flat[place], starts[place]
        before = np.where(fresh, _BEGIN, np.where(flat[place - 1] >= OWN, flat[place - 1] - 1, flat[place - 1]))
        carried = (~fresh).astype(np.float32)[:, None, :]
        state = np.zeros((STATE, STREAMS), dtype=np.float32)
        for window in range(0, steps, WINDOW):
            used = slice(window, window + WINDOW)
            kept = self._forward(self.weights["embedding"][before[used]], carried[used], state)
            state = kept[-1][-1]
            target = block[used].ravel()
            _, slope, slopes = self.output(_as_rows(kept[-1]), target, True)
            vectors = self._back(kept, carried[used], slope, slopes)
            self._adapt(slopes, before[used].ravel(), vectors, rate / len(target) ** 0.5, memory)

    def _forward(self, inputs: np.ndarray, carried: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The steps of one window, as ``step`` makes them, with a column for each stream: what ``_back`` needs, and the states after."""
        x = self.weights["inward"].T @ inputs.transpose(0, 2, 1) + self.weights["inward_bias"][:, None]
        across = np.ascontiguousarray(self.weights["across"].T)
        gates, inner, new, given, after = (np.empty((len(x), n * STATE, STREAMS), dtype=np.float32) for n in (2, 1, 1, 1, 1))
        for k in range(len(x)):
            np.multiply(state, carried[k], out=given[k])
            a = across @ given[k]
            gate = np.add(x[k, : 2 * STATE], a[: 2 * STATE], out=gates[k])
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            inner[k] = a[2 * STATE :]
            fresh = np.multiply(gate[STATE:], inner[k], out=new[k])
            fresh += x[k, 2 * STATE :]
            np.tanh(fresh, out=fresh)
            state = np.subtract(given[k], fresh, out=after[k])
            state *= gate[:STATE]
            state += fresh
        return inputs, gates, inner, new, given, after

    def _back(self, kept: tuple[np.ndarray, ...], carried: np.ndarray, slope: np.ndarray, slopes: dict) -> np.ndarray:
        """Backpropagation through the steps of one window; fills ``slopes``, returns those of the inputs."""
        w = self.weights
        inputs, gates, inner, new, given, _ = kept
        n = len(inputs)
        slope = np.ascontiguousarray(slope.reshape(n, STREAMS, STATE).transpose(0, 2, 1))
        z, r = gates[:, :STATE], gates[:, STATE:]
        # what a slope of the state after a step is multiplied with, for each gate and for the new state
        to_new = (1 - z) * (1 - new**2)
        factors = np.stack(((given - new) * z * (1 - z), to_new * inner * r * (1 - r), to_new * r), axis=1)
        outer = np.empty_like(factors)
        flat = outer.reshape(n, 3 * STATE, STREAMS)
        later = np.zeros((STATE, STREAMS), dtype=np.float32)
        for k in range(n - 1, -1, -1):
            d = slope[k]
            d += later
            np.multiply(factors[k], d, out=outer[k])
            later = w["across"] @ flat[k]
            later += d * z[k]
            later *= carried[k]
        slopes["across"] = (given @ flat.transpose(0, 2, 1)).sum(axis=0)
        outer[:, 2] = slope * to_new  # from here on the slopes of the projected inputs
        slopes["inward"] = (flat @ inputs).sum(axis=0).T
        slopes["inward_bias"] = flat.sum(axis=(0, 2))
        return _as_rows(w["inward"] @ flat)

    def _adapt(self, slopes: dict, rows: np.ndarray, vectors: np.ndarray, rate: float, memory: dict) -> None:
        """Steps by the slopes, each divided by the root of the sum of its squares so far."""
        for name, slope in slopes.items():
            sums = _sums(memory, name, slope)
            sums += slope * slope
            change = np.sqrt(sums)
            np.divide(slope, change, out=change)
            change *= np.float32(rate)
            self.weights[name] -= change
        order = np.argsort(rows.astype(np.int16), kind="stable")
        used, begins = np.unique(rows[order], return_index=True)
        slope = np.add.reduceat(vectors[order], begins, axis=0)
        sums = _sums(memory, "embedding", self.weights["embedding"])
        sums[used] += slope * slope
        self.weights["embedding"][used] -= rate * slope / np.sqrt(sums[used])


def _as_rows(columns: np.ndarray) -> np.ndarray:
    """Columns of each step as rows, step after step."""
    return np.ascontiguousarray(columns.transpose(0, 2, 1)).reshape(-1, columns.shape[1])


def _sums(memory: dict, name: str, like: np.ndarray) -> np.ndarray:
    """The sums of squares so far, from a small start."""
    if name not in memory:
        memory[name] = np.full(like.shape, 1e-2, dtype=np.float32)
    return memory[name]


RATE, LATER_RATE = 3.0, 1.5


def _ids(found: list[bytes], rank: dict[bytes, int]) -> np.ndarray:
    """Targets of a document's words and its end."""
    get = rank.get
    ids = [r if (r := get(w)) is not None else OWN + 1 + _ending(w) for w in found]
    ids.append(OWN)
    return np.array(ids, dtype=np.int32)


def _trainer(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        model = _model(vocabulary, flat)
        memory: dict = {}
        read = 0
        for batch in batches:
            ids = [_ids(tokens(t.as_py()), vocabulary.rank) for t in words.text_column(batch)]
            for k in range(0, len(ids), 512):
                model.learn(ids[k : k + 512], rate, memory)
            read += sum(map(len, ids))
        if read:
            flat = model.flat()
            columns = {"place": np.arange(len(flat), dtype=np.int32), "weight": flat.astype(np.float64) * read}
            yield pa.RecordBatch.from_pydict(columns | {"read": np.full(len(flat), float(read))})

    return run


def _model(vocabulary: Vocabulary, flat: np.ndarray | None) -> Model:
    model = Model(vocabulary)
    if flat is not None:
        model.set_flat(flat)
    return model


def _averaged(sample: DataFrame, vocabulary: Vocabulary, flat: np.ndarray | None, rate: float) -> np.ndarray | None:
    """Weights after one pass over ``sample``, averaged over its partitions by the tokens that they read."""
    shared = sample.sparkSession.sparkContext.broadcast((vocabulary, flat))  # sizes fixed by SENT and the model's shape
    read = sample.mapInArrow(_trainer(shared, rate), "place int, weight double, read double")
    rows = read.groupBy("place").agg((F.sum("weight") / F.sum("read")).alias("weight")).toPandas()
    if not len(rows):
        return flat
    found = np.zeros(len(rows), dtype=np.float32)
    found[rows["place"].to_numpy()] = rows["weight"].to_numpy()
    return found


def counted(texts: DataFrame) -> DataFrame:
    """word, train and total of all words of ``texts`` (text, held_out); the end is the NULL word."""
    partial = texts.select("text", "held_out").mapInArrow(_count, _COUNTS)
    return partial.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def _least_total(known: DataFrame) -> int:
    """The count above which there are ``SENT`` words at most; found by how many words have each count."""
    totals = known.groupBy("total").agg(F.count("*").alias("n"))
    # the SENT greatest counts are enough, as each has one word at least
    above = 0
    for row in totals.orderBy(F.desc("total")).limit(SENT).toLocalIterator():
        above += row.n
        if above > SENT:
            return row.total
    return 0


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The part of the counts that goes to the tasks."""
    sums = counts.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("train") > 0).alias("words"),
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("train"))), F.lit(0)).alias("ends"),
    ).first()
    known = counts.filter("word is not null")
    sent = known.filter(F.col("total") > _least_total(known)).select("word", "train").toArrow()  # SENT words at most
    most = known.filter("train > 0").orderBy(F.desc("train"), "word").limit(OWN).select("word", "train").toArrow()
    rank = {w: k for k, w in enumerate(most["word"].to_pylist())}
    ending = (F.crc32(F.expr(f"substring(word, -least({ENDING_BYTES}, length(word)))")) % ENDINGS).alias("ending")
    kinds = known.filter("train > 0").groupBy(ending).agg(F.sum("train").alias("tokens"), F.count("*").alias("words"))
    other = np.zeros((2, ENDINGS), dtype=np.int64)
    for row in kinds.collect():
        other[:, row.ending] = row.tokens, row.words
    for word, count in zip(rank, most["train"].to_pylist(), strict=True):
        other[:, _ending(word)] -= count, 1
    pairs = zip(sent["word"].to_pylist(), sent["train"].to_pylist(), strict=True)
    own = most["train"].to_numpy().astype(np.int64)
    return Vocabulary(dict(pairs), rank, own, *other, sums.ends, sums.tokens, sums.words)


def trained(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray | None:
    """Weights fitted to all training documents (doc_id, text, held_out)."""
    train = texts.filter("not held_out").select("doc_id", "text")
    first = train.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_ROWS)
    start = train.join(F.broadcast(first), "doc_id", "left_semi")  # START_ROWS numbers
    # a doc_id may have any number of rows
    order = [F.xxhash64("doc_id", "text"), "doc_id", "text"]  # whatever order the rows arrive in
    start = start.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(START_ROWS)
    flat = _averaged(start.repartition(1).sortWithinPartitions(*order).select("text"), vocabulary, None, RATE)
    shards = int(vocabulary.train_tokens // SHARD_TOKENS) + 2
    rounds = shards.bit_length()
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for k in range(rounds):
        dealt = train.filter(turn == k).repartition(-(-shards // rounds)).sortWithinPartitions(*order)
        flat = _averaged(dealt.select("text"), vocabulary, flat, LATER_RATE)
    return flat


_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, own double, other_sum double,"
    " rest array<struct<word: binary, times: int>>"
)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        model = _model(vocabulary, flat)
        counts, rank, within = vocabulary.counts, vocabulary.rank, vocabulary.other
        for batch in batches:
            ids, known, base, other_sum, rest = [], [], [], [], []
            for text in words.text_column(batch):
                found = tokens(text.as_py())
                ids.append(_ids(found, rank))
                seen = [counts.get(w, -1) for w in found]
                seen.append(vocabulary.ends)
                count = np.array(seen, dtype=np.float64)
                logs = np.log10(np.maximum(count, 0) + 1)
                known.append(int((count > 0).sum()))
                base.append(float(logs.sum()))
                other = ids[-1] > OWN
                other_sum.append(float((logs[other] - within[ids[-1][other] - OWN - 1]).sum()))
                far = Counter(found[k] for k in np.flatnonzero(count < 0))
                rest.append([{"word": w, "times": n} for w, n in far.items()])
            kinds = {f.name: f.type for f in _RESULT}
            columns = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")}
            columns |= {"n_tokens": [len(i) for i in ids], "known": known, "base": base}
            columns |= {"own": model.read(ids) / np.log(10), "other_sum": other_sum, "rest": rest}
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[n]) for n, c in columns.items()]
            yield pa.RecordBatch.from_arrays(arrays, schema=_RESULT)

    return run


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("base", pa.float64()),
        ("own", pa.float64()),
        ("other_sum", pa.float64()),
        ("rest", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))),
    ]
)


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = documents.sparkSession
    id_ = F.col("doc_id").cast("bigint").alias("doc_id")
    texts = documents.select(id_, "text", held_out(FOLDS, HELD_OUT).alias("held_out"))
    counts = cut(counted(texts))
    vocabulary = vocabulary_of(counts)
    weights = trained(texts, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, weights))  # sizes fixed by SENT and the model's shape
    scored = cut(texts.mapInArrow(_scorer(shared), _SCORED)).withColumn("row", F.monotonically_increasing_id())
    rest = scored.select("row", F.explode("rest").alias("rest")).select("row", "rest.*")
    rest = rest.join(counts.filter("word is not null").select("word", "train"), "word")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("train") + 1.0)).alias("rest_sum"),
        F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    joined = scored.drop("rest").join(rest, "row", "left").fillna(0, ["rest_sum", "rest_known"])
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rest_known")).cast("bigint").alias("n_known"),
        F.lit(vocabulary.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rest_sum") - F.col("n_tokens") * F.lit(vocabulary.base)).alias("base_score"),
        (F.col("own") + F.col("other_sum") + F.col("rest_sum")).alias("score"),
    )


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document under the recurrent model and under the base."""
    return scores(table(spark, sf_dir, "documents"))
