"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on every document; they overlap and disagree. Expectation-maximisation
(the Dawid-Skene model with abstention) estimates from the vote patterns how far each can be trusted, and gives every
pattern a posterior. Two such models run: one for junk, one for toxic language. The table of labels, where it has a
document, is one more labeller of each. Posterior labels then train a hashed linear scorer per model (logistic
regression over hashed words, word beginnings and binned measures), which scores every document, labelled or not.

What the other labellers learn from labels, they never learn from the document they judge, so that they err
independently of ``label``: a document's toxic terms are counted over the other three quarters of the labels, and where
good documents' measures lie is seen in a quarter in which ``label`` doesn't vote.

One pass over the texts writes each row's measures and hashed bins; votes, posteriors and scores come from those.
Only counts of vote patterns (3 ** labellers at most), quantiles and a bounded training sample reach the driver: about
``sample_rows`` rows (half from either side of the posterior of each model), each with ``SAMPLE_BINS`` bins at most;
both are documented bounds of the classifier.

Edge cases: null and wordless texts are never kept; very long texts are measured whole, one at a time; labels with nulls
or without a document are ignored; without labels the heuristics decide alone, by fixed cut-offs; a posterior of exactly
one half counts as bad; repeated rows are scored row by row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, core, written
from webloom.llm.quality_rules import clean_labels, count_in, fold, letter_words, lexicon_counts, measure, stems, telling_terms

ABSTAIN, GOOD, BAD = 0, 1, 2
BITS = 18
SAMPLE_ROWS = 16_000
#: Bins of a training row: the least hashes.
SAMPLE_BINS = 4096
#: Good documents from which a cut-off is learned.
FEWEST = 40

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    b"the of and to in a is that it was for on are as with be at by this from or an der die und das ist nicht von zu den mit ein eine sich auf auch es im dem "
    b"le la les de des et est un une que qui en du pas pour dans sur au avec el los las que y en un una por con del se no su al lo".split()
)
# Frequent function words of English alone.
ENGLISH = frozenset(b"the of and to is that it was for are as with be by this from or".split())
# Common English insults.
INSULTS = frozenset(b"idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless clown disgusting filth vermin imbecile".split())

#: Measures of a text: name -> (lowest good value, lowest sure value, highest sure value, highest good value), used where
#: there are too few labels to learn from. A labeller votes bad outside the good values, and good inside the sure ones.
MEASURES = {
    "symbols": (None, None, 0.02, 0.08),
    "shouting": (None, None, 0.1, 0.4),
    "repeats": (None, None, 0.1, 0.3),
    "dup_lines": (None, None, 0.1, 0.3),
    "stutter": (None, None, 0.03, 0.2),
    "function_words": (0.02, 0.06, None, None),
    "word_length": (0.1, 0.15, 0.45, 0.7),
    "insults": (None, 0.0, 0.0, 0.002),
    "learned_words": (None, None, 0.0, 0.001),
}
JUNK = ("symbols", "shouting", "repeats", "dup_lines", "stutter", "function_words", "word_length", "length", "label")
TOXIC = ("insults", "learned_words", "label")
#: Shares of good documents beyond the cut-offs that are learned: outside the good values, outside the sure ones.
OUTSIDE, UNSURE = 0.005, 0.1


def measured_values(text: str | None, words: list[bytes], lexicon: frozenset[bytes]) -> tuple[int, list[float]]:
    """Number of words and the values of MEASURES of one text; insults are -1, and their labeller silent, where the text
    isn't English. words: its letter_words()."""
    n, chars, _, _, _, symbols, shouting, repeats, dup_lines, toxic = measure(text, lexicon, words)
    m = max(1, len(words))
    stop = sum(map(STOP_WORDS.__contains__, words)) / m
    stutter = sum(map(bytes.__eq__, words, words[1:])) / m
    english = sum(map(ENGLISH.__contains__, words)) >= 0.08 * m
    insults = count_in(words, INSULTS) / m if english else -1.0
    return n, [symbols, shouting, repeats, dup_lines, stutter, stop, chars / max(1, n) / 20, insults, toxic]


def pattern(each: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(each))


def unpack(patterns: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(patterns // 3**k) % 3 for k in range(n)], axis=1)


def em(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 200, trusted: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of bad per pattern, P(vote | class) [labeller, class, vote], prior of bad).

    Labellers vote independently given the class. Bad documents are bad in one way or another, so one bad vote starts a
    document as rather bad, however many others see nothing. An informative prior (each labeller is right 8 times in 10,
    worth 20 votes) keeps the classes from swapping where votes are few. Where the ``trusted`` labeller votes, its vote
    is held for right 99 times in 100 whatever the others say: heuristics that share a blind spot can't outvote it.
    """
    v = unpack(patterns, n)
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    post = np.clip(np.where(bad > 0, 1 - 0.4**bad, 0.3 / (good + 1.0)), 0.02, 0.98)
    told = np.zeros(len(v), np.int64) if trusted is None else v[:, trusted]
    belief = np.zeros((n, 2, 3))
    for k in range(n):
        belief[k] = [[4, 16, 4], [4, 4, 16]]
    for _ in range(rounds):
        post = np.where(told == BAD, 0.99, np.where(told == GOOD, 0.01, post))
        w = np.stack([counts * (1 - post), counts * post])
        table = belief.copy()
        for k in range(n):
            for vote in range(3):
                table[k, :, vote] += w[:, v[:, k] == vote].sum(axis=1)
        table /= table.sum(axis=2, keepdims=True)
        prior = float(np.clip((w[1].sum() + 1) / (counts.sum() + 2), 0.001, 0.5))
        logs = np.log(table)
        score = np.log(prior) - np.log1p(-prior) + sum(logs[k, 1, v[:, k]] - logs[k, 0, v[:, k]] for k in range(n) if k != trusted)
        fresh = np.where(told == BAD, 0.99, np.where(told == GOOD, 0.01, 1 / (1 + np.exp(-np.clip(score, -50, 50)))))
        if np.abs(fresh - post).max() < 1e-7:
            post = fresh
            break
        post = fresh
    return post, table, prior


def features(words: list[bytes], values: list[float], known: dict[bytes, int]) -> np.ndarray:
    """Hashed bins: the distinct words, their beginnings, and each measure cut into steps."""
    digest = xxhash.xxh32_intdigest
    if len(known) > 200_000:
        known.clear()
    out = []
    own = set(words)
    for w in own | stems(own):
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w) & ((1 << BITS) - 1)
        out.append(h)
    for k, x in enumerate(values):
        out.append(digest(f"\x00{k}:{int(np.ceil(min(1.0, x) * 25))}".encode()) & ((1 << BITS) - 1))
    return np.unique(np.array(out, np.int32))


def train(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, batch: int = 64) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over hashed bins, with lasso truncation; the same input gives the same weights."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, rng = 0.0, np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            flat = np.concatenate([rows[i] for i in take])
            lengths = np.array([len(rows[i]) for i in take])
            owner = np.repeat(np.arange(len(take)), lengths)
            z = np.bincount(owner, weights=w[flat], minlength=len(take)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[take]) * weight[take] / batch
            bins, inverse = np.unique(flat, return_inverse=True)
            grad = np.bincount(inverse.reshape(-1), weights=err[owner])
            g2[bins] += grad * grad
            step = rate / np.sqrt(g2[bins])
            fresh = w[bins] - step * grad
            w[bins] = np.sign(fresh) * np.maximum(0.0, np.abs(fresh) - step * decay)
            bias -= rate * err.sum()
    return w, bias


def lexicons(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> list[frozenset[bytes]]:
    """By quarter of the documents: the toxic terms of the labels of the other three; of all of them, where no ``sample_rows`` is given."""
    counts = lexicon_counts(docs, labels, (0, 1, 2, 3), sample_rows)
    return [telling_terms(counts, tuple(g for g in range(4) if g != f)) for f in range(4)]


def measures(docs: DataFrame, known: list[frozenset[bytes]]) -> DataFrame:
    """Per document row: doc_id, n_words, the values of MEASURES, and its hashed bins. known: lexicons()."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batch: pa.RecordBatch, seen: dict[bytes, int] = {}) -> dict:  # noqa: B006  one for each task
        out = {"doc_id": batch.column("doc_id"), "n_words": [], "vals": [], "bins": []}
        for text, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            words = letter_words(text)
            n, values = measured_values(text, words, shared.value[f])
            out["n_words"].append(n)
            out["vals"].append(values)
            out["bins"].append(features(words, values, seen).tobytes())
        return out

    rows = core(docs, "doc_id", "text").withColumn("fold", F.coalesce(fold(), F.lit(0)).cast("int"))
    return arrow_map(rows, run, "doc_id long, n_words long, vals array<double>, bins binary")


def learned_cutoffs(measured: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> dict[str, tuple]:
    """MEASURES with the cut-offs that the good documents of the fitting quarter show: all of them, where no ``sample_rows`` is given."""
    fit = labels.filter((fold() == 0) & (F.col("quality") > 0) & (F.col("toxic") == 0)).select("doc_id")
    if sample_rows is not None:
        fit = fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    shares = [OUTSIDE, UNSURE, 1 - UNSURE, 1 - OUTSIDE]
    rows = measured.select("doc_id", "n_words", "vals").join(fit, "doc_id").filter("n_words > 0")
    found = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(F.col("vals")[k], shares, 10_000).alias(f"q{k}") for k in range(len(MEASURES)))).first()
    if not found or found["n"] < FEWEST:
        return dict(MEASURES)
    learned = {name: tuple(q if side is not None else None for side, q in zip(sides, found[f"q{k}"], strict=True)) for k, (name, sides) in enumerate(MEASURES.items())}
    return learned | {"insults": (None, 0.0, *(max(0.0, q) for q in learned["insults"][2:]))}


def vote(name: str, cutoffs: dict[str, tuple]):
    """The vote of a measure's labeller, as a column."""
    value = F.col("vals")[list(MEASURES).index(name)]
    low, sure_low, sure_high, high = cutoffs[name]
    inside = F.lit(True)
    out = F.lit(ABSTAIN)
    if sure_low is not None:
        inside = inside & (value >= sure_low)
    if sure_high is not None:
        inside = inside & (value <= sure_high)
    out = F.when(inside, GOOD).otherwise(out)
    if low is not None:
        out = F.when(value < low, BAD).otherwise(out)
    return F.when(value > high, BAD).otherwise(out) if high is not None else out


def weak_labels(measured: DataFrame, labels: DataFrame, cutoffs: dict[str, tuple]) -> DataFrame:
    """measured rows with the vote patterns ``junk`` and ``toxic``. ``label`` doesn't vote in the fitting quarter."""
    gold = labels.filter(fold() != 0).select(
        F.col("doc_id").alias("_id"), F.when(F.col("quality") > 0, GOOD).otherwise(BAD).alias("_q"), F.when(F.col("toxic") > 0, BAD).otherwise(GOOD).alias("_t")
    )
    both = measured.join(gold, F.col("doc_id") == F.col("_id"), "left")
    length = F.when(F.col("n_words") < 20, BAD).when(F.col("n_words") >= 50, GOOD).otherwise(ABSTAIN)

    def votes(names: tuple[str, ...], label: str):
        each = [length if n == "length" else F.coalesce(F.col(label), F.lit(ABSTAIN)) if n == "label" else vote(n, cutoffs) for n in names]
        return sum(v * 3**k for k, v in enumerate(each)).cast("int")

    return both.select("rid", "doc_id", "n_words", votes(JUNK, "_q").alias("junk"), votes(TOXIC, "_t").alias("toxic"))


def posteriors(found: dict[int, int], names: tuple[str, ...]) -> tuple[dict[int, float], dict[str, dict[str, float]]]:
    """Posterior of bad for every vote pattern (pattern -> rows), and each labeller's estimated accuracy on either class."""
    if not found:
        return {}, {}
    patterns = np.array(sorted(found))
    post, table, _ = em(patterns, np.array([found[p] for p in sorted(found)], float), len(names), trusted=names.index("label"))
    accuracy = {n: {"good": float(table[k, 0, GOOD] / (1 - table[k, 0, ABSTAIN])), "bad": float(table[k, 1, BAD] / (1 - table[k, 1, ABSTAIN]))} for k, n in enumerate(names)}
    return dict(zip(map(int, patterns), map(float, post), strict=True)), accuracy


def fit(measured: DataFrame, voted: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, tuple[np.ndarray, float]], dict[str, dict]]:
    """A scorer for each model from a bounded sample with posterior labels, and each model's labeller accuracies."""
    found = voted.groupBy("junk", "toxic").count().collect()
    post, accuracy, share, prior = {}, {}, {}, {}
    for name, labellers in (("junk", JUNK), ("toxic", TOXIC)):
        rows: dict[int, int] = {}
        for r in found:
            rows[r[name]] = rows.get(r[name], 0) + r["count"]
        post[name], accuracy[name] = posteriors(rows, labellers)
        sides = [sum(n for p, n in rows.items() if (post[name][p] >= 0.5) == bad) for bad in (False, True)]
        prior[name] = min(0.5, max(1e-4, sum(n * post[name][p] for p, n in rows.items()) / max(1, sum(rows.values()))))
        share[name] = [min(1.0, sample_rows / 4 / max(1, n)) for n in sides]
    if not found:
        return {name: (np.zeros(1 << BITS), 0.0) for name in post}, accuracy
    spark = voted.sparkSession
    judged = spark.createDataFrame(
        [
            (r["junk"], r["toxic"], post["junk"][r["junk"]], post["toxic"][r["toxic"]], max(share[n][int(post[n][r[n]] >= 0.5)] for n in post))
            for r in found
        ],
        "junk int, toxic int, p_junk double, p_toxic double, share double",
    )
    drawn = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < F.col("share") * float(1 << 30)
    chosen = voted.join(F.broadcast(judged), ["junk", "toxic"]).filter(drawn).select("rid", "p_junk", "p_toxic")
    few = F.expr(f"substring(bins, 1, {4 * SAMPLE_BINS})").alias("bins")
    sample = measured.select("rid", "doc_id", few).join(F.broadcast(chosen), "rid").drop("rid").toPandas().sort_values(["doc_id", "bins"])
    bins = [np.frombuffer(x, np.int32) for x in sample["bins"]]
    models = {}
    for name in post:
        p = sample[f"p_{name}"].to_numpy()
        bad = max(1e-3, (p >= 0.5).mean()) if len(p) else 0.5
        w, bias = train(bins, p, np.where(p >= 0.5, min(20.0, 0.5 / bad), 0.5 / max(1e-3, 1 - bad)) * np.abs(2 * p - 1))
        models[name] = w, bias + float(np.log(prior[name]) - np.log1p(-prior[name]))  # trained on even sides
    return models, accuracy


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, quality and toxicity (0..1, of the trained scorers; quality is high for good
    text), kept (quality at least 0.5 and toxicity below 0.5)."""
    known = clean_labels(labels)
    measured = written(measures(docs, lexicons(docs, known)).withColumn("rid", F.monotonically_increasing_id()), "op10-measures")
    voted = written(weak_labels(measured, known, learned_cutoffs(measured, known)), "op10-voted")
    models, _ = fit(measured, voted, sample_rows)
    weights = np.stack([models["junk"][0], models["toxic"][0]], axis=1).astype(np.float32)
    bias = np.array([models["junk"][1], models["toxic"][1]])
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batch: pa.RecordBatch) -> dict:
        w, b = shared.value
        rows = [np.frombuffer(x, np.int32) for x in batch.column("bins").to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
        scores = np.add.reduceat(w[np.concatenate(rows)], starts, axis=0) + b  # every row has the bins of its measures
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        return {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "quality": 1 - p[:, 0], "toxicity": p[:, 1]}

    out = arrow_map(measured.select("doc_id", "n_words", "bins"), run, "doc_id long, n_words long, quality double, toxicity double")
    return out.withColumn("kept", (F.col("n_words") > 0) & (F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5))


__all__ = ["classify", "em", "posteriors", "train", "weak_labels"]
