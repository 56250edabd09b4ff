"""Quality classifier by hierarchical empirical Bayes.

A logistic model on words, word beginnings and text statistics gives each document's own evidence that it is bad. The
rates of bad documents of each host and path are aggregated over all documents (labels where there are any, else the
model's probability) and shrunk: a path towards its host, a host towards the global rate. How many documents a prior is
worth is the variance within sites over the variance between them, both estimated from all sites. A document's own
evidence is left out of its sites' sums; its logit is then moved by what its path says beyond the global rate.

The model is fitted on a sample of at most about `sample` labelled documents, chosen by hash; nothing else is sampled.

Nulls and edges: a null text is empty; null labels count as good; a null host or path is a site of its own; an id that
is labelled twice is bad if either label says so; rows with equal ids are scored each; without labelled documents of
both kinds every document's own probability is 0; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, materialise, release, utf8, with_groups
from rasterloom.session import ship

SAMPLE = 20_000
#: Words and word beginnings that the model keeps, the most telling ones by chi-square, and the least of that.
FEATURES, TELLING = 4096, 12.0


def word_features(word: bytes) -> list[int]:
    """The hashes of a word and of its beginning."""
    out = [zlib.crc32(b"w" + word)] if len(word) <= 24 else []
    return out + [zlib.crc32(b"p" + word[:5])] if len(word) > 5 else out


def statistics(text: bytes, words: list[bytes], kinds: set[bytes]) -> list[float]:
    """Shares of kinds of characters, repetition of words and lines, length."""
    import numpy as np

    n = max(1, len(text))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    signs = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    return [c[65:91].sum() / n, c[48:58].sum() / n, signs / n, c[124] / n, c[[33, 35, 36, 37, 38, 42]].sum() / n, float(np.log1p(len(words))), len(kinds) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), n / max(1, len(words)) / 10, c[10] / n]


class Model:
    """Weights of a logistic model; logit() gives a text's log-odds of being bad."""

    def __init__(self, features: dict[int, int], weights, mean, scale, dense, bias: float):
        self.features, self.weights, self.mean, self.scale, self.dense, self.bias, self.cache = features, weights, mean, scale, dense, bias, {}

    def logit(self, text: bytes) -> float:
        import numpy as np

        words = text.lower().split()
        kinds, known, found = set(words), self.cache, set()
        if len(known) > 300_000:
            known.clear()
        for w in kinds:
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(self.features[f] for f in word_features(w) if f in self.features)
            if at:
                found.update(at)
        x = np.clip((np.array(statistics(text, words, kinds)) - self.mean) / self.scale, -5, 5)
        return float(self.bias + self.weights[sorted(found)].sum() + x @ self.dense)


def fit(y, sparse: list, stats, features: dict[int, int], epochs: int = 6, rate: float = 0.3) -> Model:
    """Logistic regression by AdaGrad, one document a step, in a fixed order."""
    import numpy as np

    mean, scale = stats.mean(0), stats.std(0) + 1e-9
    x = np.clip((stats - mean) / scale, -5, 5)
    w, v, b = np.zeros(max(1, len(features))), np.zeros(x.shape[1]), 0.0
    gw, gv, gb = np.ones_like(w), np.ones_like(v), 1.0
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at = sparse[i]
            g = 1 / (1 + np.exp(-np.clip(b + w[at].sum() + x[i] @ v, -30, 30))) - y[i]
            gw[at] += g * g
            w[at] -= rate * g / np.sqrt(gw[at])
            gv += (g * x[i]) ** 2
            v -= rate * g * x[i] / np.sqrt(gv)
            gb += g * g
            b -= rate * g / np.sqrt(gb)
    return Model(features, w, mean, scale, v, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text. labels: doc_id, bad (0 or 1)."""
    import numpy as np

    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    n = labels.count()
    share = int(2**40 * min(1.0, sample / max(n, 1)))
    chosen = {r["doc_id"]: r["bad"] for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) < share).collect()}

    def features(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            at = [i for i, d in enumerate(ids) if d in chosen]
            rows = []
            for i, text in zip(at, utf8(texts.take(pa.array(at, pa.int64())))):
                words = text.lower().split()
                kinds = set(words)
                rows.append((ids[i], chosen[ids[i]], sorted({f for w in kinds for f in word_features(w)}), statistics(text, words, kinds)))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.float64()))], ["doc_id", "bad", "features", "stats"])

    rows, _ = materialise(docs.select("doc_id", "text").mapInArrow(features, "doc_id long, bad int, features array<long>, stats array<double>"), "labelled")
    bad, good = (rows.agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).first()[k] or 0 for k in "bg")
    if not bad or not good:
        return None
    counts = rows.select("bad", F.explode("features").alias("f")).groupBy("f").agg(F.sum("bad").alias("b"), F.count("*").alias("n")).where("n >= 4")
    expected = F.col("n") * bad / (bad + good)
    chi = F.pow(F.col("b") - expected, 2) * (1 / expected + 1 / (F.col("n") - expected))
    best = counts.withColumn("chi", chi).where(F.col("chi") > TELLING).orderBy(F.desc("chi"), "f").limit(FEATURES).select("f").collect()
    index = {r["f"]: i for i, r in enumerate(best)}
    kept = F.array_intersect("features", F.array(*[F.lit(f).cast("long") for f in index]) if index else F.array().cast("array<long>"))
    # A few dozen features and ten numbers of each of the sampled documents.
    fitted = rows.select("doc_id", "bad", kept.alias("kept"), "stats").toPandas().sort_values("doc_id")
    sparse = [np.array(sorted(index[f] for f in x), np.int64) for x in fitted["kept"]]
    return fit(fitted["bad"].to_numpy(), sparse, np.array(fitted["stats"].tolist()), index)


def _strength(groups: DataFrame, parent: Column) -> float:
    """How many documents the prior is worth, of groups (n, e, q): their numbers, sums and sums of squares of the evidence.

    By the method of moments: the variance within groups over the variance of their rates around the parent's, less
    what chance gives.
    """
    rate = F.col("e") / F.col("n")
    inside, spread = F.sum(F.col("q") - F.col("e") * rate), F.sum(F.col("n") * F.pow(rate - parent, 2))
    r = groups.agg(inside.alias("inside"), spread.alias("spread"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not r["k"] or r["n"] <= r["k"]:
        return 1.0
    within = max(r["inside"], 0.0) / (r["n"] - r["k"])
    between = (r["spread"] - r["k"] * within) / r["n"]
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, logit, host_rate, path_rate, p_bad): a document's own log-odds, the shrunk rates of its sites' others, and the outcome.

    labels: doc_id, bad. host, path: of docs' columns; a path belongs to its host.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad"))
    model = train(rows, labels, sample)

    def logits(batches: Iterable) -> Iterator:
        import pyarrow as pa

        release()
        for b in batches:
            z = [model.logit(t) for t in utf8(b.column("text"))] if model else [float("-inf")] * b.num_rows
            yield pa.record_batch([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(z, pa.float64())], ["doc_id", "host", "path", "logit"])

    own, path_of_own = materialise(rows.mapInArrow(logits, "doc_id long, host string, path string, logit double"), "logits")
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    judged, _ = materialise(own.join(known, "doc_id", "left").withColumn("e", F.coalesce(F.col("bad").cast("double"), sigmoid(F.col("logit")))).drop("bad"), "evidence")
    discard(docs.sparkSession, path_of_own)
    paths, _ = materialise(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("e"), F.sum(F.col("e") * F.col("e")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("q").alias("q"))
    whole = hosts.agg(F.sum("e").alias("e"), F.sum("n").alias("n")).first()
    prior = min(1 - 1e-6, max(1e-6, (whole["e"] or 0.0) / max(1, whole["n"] or 0)))
    s = _strength(hosts, F.lit(prior))
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("e").alias("he"))
    shrunk = lambda e, n, strength, towards: (e + strength * towards) / (n + strength)
    under = paths.join(hosts, "host")
    t = _strength(under, shrunk(F.col("he"), F.col("hn"), s, prior))
    sites, _ = materialise(under.select("host", "path", "n", "e", "hn", "he", F.col("n").alias("_rl_n")).withColumnsRenamed({"n": "pn", "e": "pe"}), "sites")
    log_odds = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    # Each row without itself.
    rows = with_groups(judged, sites, ["host", "path"]).withColumn("host_rate", inside(shrunk(F.col("he") - F.col("e"), F.col("hn") - 1, s, prior)))
    rows = rows.withColumn("path_rate", inside(shrunk(F.col("pe") - F.col("e"), F.col("pn") - 1, t, F.col("host_rate"))))
    shift = log_odds(F.col("path_rate")) - log_odds(F.lit(prior))
    return rows.select("doc_id", "logit", "host_rate", "path_rate", sigmoid(F.col("logit") + shift).alias("p_bad"))


def bad_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of the labels table: of low quality or toxic."""
    return labels.select("doc_id", F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int").alias("bad"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, reject: float = 0.4) -> DataFrame:
    """The documents with p_bad up to `reject`, with all their columns; rows with equal ids go together."""
    gone = score(docs, labels, host, path).where(F.col("p_bad") > reject).select(F.col("doc_id").alias("_rl_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_rl_id"]), "left_anti")
