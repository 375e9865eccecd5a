"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become class symbols by a lexicon transducer: insult, threat, target, negation, reported
speech, or other.  A transducer that reads a clause from its end marks insults and threats with a
target after them.  Three more, composed into one machine that reads from the start, mark those within
reach of a negation, those after a verb of reported speech and those with a target before them, and
the machine's last part weighs each marked symbol: aimed insults and threats count in full, bare ones a
fraction, negated and reported ones less again.  A clause's score is the sum over its matches of the
lexicon's weight times the machine's.  Documents are scored by their clauses, calibrated by a logistic
curve; clauses of a batch advance through the machines together, word by word.

The closed classes are word lists; of insults a few are listed, and the rest is learned: whole words
and word beginnings that occur in clearly more toxic documents than chance allows.  The fit uses a
bounded sample (``SAMPLE_ROWS`` labelled documents of ``fitting.SAMPLE_BYTES`` together), in which
texts that share a good part of their word triples count once; the calibration scores each of its
``FOLDS`` parts with the lexicon of the others.  Scoring reads every clause of every text.

Null and empty texts have no clause and get the score of a text without matches.  Very long texts are
read whole, in pieces of bounded size that end between words.  Repeated rows are scored each, equal
texts alike; a score equal to the threshold is toxic.  Without labels of both kinds the listed words
alone decide, with a fixed curve.  Extra columns are ignored, whatever their names, and an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fitting, tables
from .fitting import sigmoid
from .textcore import ALPHA, U64, Words, mix, row_slices, string_buffer, word_hash, words

SAMPLE_ROWS = 9000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
#: What a learned entry needs: log likelihood ratio above the log of the sample's documents, documents, weight.
EVIDENCE, DOCUMENTS, LEAST = 0.0, 3, 2.0
FOLDS = 4
#: Words over which a negation reaches.
REACH = 3
#: Min-wise hashes of a sampled text's word triples, and how many equal ones make two texts count once.
SKETCH, ALIKE = 16, 5
#: Factors of the machine: a bare insult or threat, one aimed at a target, and what marks leave of them.
BARE, BARE_THREAT, AIMED, NEGATED, QUOTED = 0.3, 0.1, 1.5, 0.25, 0.3

# Closed word classes of English, German, French and Spanish.  Words end at a straight
# apostrophe, so contracted negations are listed by what comes before it.
WORDS = {
    "insult": "idiot moron stupid loser scum worthless pathetic disgusting trash clown imbecile dumb fool jerk bastard idiota estúpido imbécil connard salaud crétin trottel arschloch dummkopf abschaum",
    "threat": "kill murder hurt destroy stab beat shoot punch strangle choke crush burn bury hunt slaughter maim cripple töten umbringen schlagen ermorden erschießen erstechen verprügeln vernichten abstechen tuer frapper égorger étrangler assassiner massacrer poignarder détruire matar golpear asesinar apuñalar estrangular destruir disparar degollar",
    "target": "you your yours he she they them him her these those du dich dein ihr euch sie tu toi vous votre ils elles tú vosotros usted ustedes ellos ellas",
    "negation": "not never nobody cannot isn aren wasn weren don doesn didn isn’t aren’t wasn’t don’t doesn’t didn’t won’t can’t without nicht kein keine keiner nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin",
    "reported": "said says told claimed called wrote quoted reported sagte sagt nannte schrieb dit écrit appelé dijo dice llamó escribió",
}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)
_CLASS = {"insult": INSULT, "threat": THREAT, "target": TARGET, "negation": NEGATION, "reported": REPORTED}
LISTED_WEIGHT = 3.0


class Transducer:
    """A deterministic weighted transducer; ``step(state, symbol)`` gives next state, output and weight.

    ``arcs`` holds what differs from the default: to copy the symbol, weight 1, and go to
    ``fallback[state]``.
    """

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], fallback: dict[int, int]):
        self.arcs, self.fallback = arcs, fallback

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (self.fallback[state], symbol, 1.0))

    def alphabet(self) -> set[str]:
        return {s for _, s in self.arcs} | {x[1] for x in self.arcs.values()}


def compose(first: Transducer, second: Transducer, symbols: set[str]) -> Transducer:
    """The machine that feeds the first one's output to the second; weights multiply."""
    ids, queue, arcs, fallback = {(0, 0): 0}, [(0, 0)], {}, {}
    while queue:
        a, b = pair = queue.pop()
        for s in symbols:
            na, mid, wa = first.step(a, s)
            nb, out, wb = second.step(b, mid)
            if (na, nb) not in ids:
                ids[na, nb] = len(ids)
                queue.append((na, nb))
            arcs[ids[pair], s] = (ids[na, nb], out, wa * wb)
        fallback[ids[pair]] = ids[pair]
    return Transducer(arcs, fallback)


SYMBOLS = "oihtnr"
HITS = "ih"


def grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The machines as tables: (targets, next states, weights).

    Symbols: o other, i insult, h threat, t target, n negation, r reported speech; hits (i and h) gain
    the marks > for a target after them, - for negated, q for reported and < for a target before them.
    ``targets[state, class]`` is the next state of the machine that reads from a clause's end; it marks
    hits in state 1.  ``next[state, symbol]`` and ``weight[state, symbol]`` are of the one that reads
    from the start, over the classes and then i> and h>.
    """
    after = Transducer({(k, "t"): (1, "t", 1.0) for k in (0, 1)} | {(1, s): (1, s + ">", 1.0) for s in HITS}, {0: 0, 1: 1})
    inputs = [*SYMBOLS, *(s + ">" for s in HITS)]
    marked = [s + m for s in HITS for m in ("", ">")]
    negation = Transducer(
        {(k, "n"): (REACH, "n", 1.0) for k in range(REACH + 1)} | {(k, s): (k - 1, s + "-", 1.0) for k in range(1, REACH + 1) for s in marked},
        {k: max(0, k - 1) for k in range(REACH + 1)},
    )
    marked = [s + m for s in marked for m in ("", "-")]
    reported = Transducer({(k, "r"): (1, "r", 1.0) for k in (0, 1)} | {(1, s): (1, s + "q", 1.0) for s in marked}, {0: 0, 1: 1})
    marked = [s + m for s in marked for m in ("", "q")]
    before = Transducer({(k, "t"): (1, "t", 1.0) for k in (0, 1)} | {(1, s): (1, s + "<", 1.0) for s in marked}, {0: 0, 1: 1})
    marked = [s + m for s in marked for m in ("", "<")]

    def weight(s: str) -> float:
        base = AIMED if ">" in s or "<" in s else BARE if s[0] == "i" else BARE_THREAT
        return base * (NEGATED if "-" in s else 1.0) * (QUOTED if "q" in s else 1.0)

    weigh = Transducer({(0, s): (0, s, weight(s)) for s in marked} | {(0, s): (0, s, 0.0) for s in "otnr"}, {0: 0})
    whole = compose(compose(compose(negation, reported, set(inputs)), before, set(inputs)), weigh, set(inputs))
    states = sorted(whole.fallback)
    table = [[whole.arcs[state, s] for s in inputs] for state in states]
    return (
        np.array([[after.step(k, s)[0] for s in SYMBOLS] for k in (0, 1)]),
        np.array([[x[0] for x in row] for row in table]),
        np.array([[x[2] for x in row] for row in table]),
    )


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    out[upper] += 32
    return out


_SAME = np.arange(256, dtype=np.uint8)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n()\""]] = True


def _cut(data: np.ndarray, offs: np.ndarray) -> Words:
    return words(folded(data), offs, ALPHA, _SAME, prefixes=PREFIXES)


def _keyed(w: Words) -> Iterator[np.ndarray]:
    """Keys of every word as a whole and by each beginning (0: too short)."""
    yield w.hash
    for p in PREFIXES:
        yield np.where(w.prefix[p] == 0, U64(0), mix(w.prefix[p] + U64(0x5BF0 + p)))


class Lexicon:
    """Sorted keys with weights, behind a bitmap by 16 low bits."""

    def __init__(self, weights: dict[int, float]):
        self.keys = np.array(sorted(weights), U64)
        self.weights = np.array([weights[int(k)] for k in self.keys])
        self.map = np.zeros(1 << 16, dtype=bool)
        self.map[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def weight(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key))
        at = np.flatnonzero(self.map[(key & U64(0xFFFF)).astype(np.int64)])
        if len(at):
            slot = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            same = self.keys[slot] == key[at]
            out[at[same]] = self.weights[slot[same]]
        return out


class Model:
    """Lexicon, closed classes, machines and calibration."""

    def __init__(self, learned: dict[int, float]):
        listed = {word_hash(x): LISTED_WEIGHT for x in WORDS["insult"].split()}
        self.lexicon = Lexicon(listed | learned)
        self.closed = Lexicon({word_hash(x): float(_CLASS[c]) for c in WORDS for x in WORDS[c].split() if c != "insult"})
        self.targets, self.next, self.weight = grammar()
        self.curve = np.array([4.0, 0.0, -5.0])

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: log of the clauses' total score, and share of clauses that match."""
        data, offs = string_buffer(column)
        out = np.zeros((len(offs) - 1, 2))
        for a, b in row_slices(offs):
            own, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            w = _cut(own, at)
            if not len(w.start):
                continue
            best = np.zeros(len(w.start))
            for key in _keyed(w):
                np.maximum(best, self.lexicon.weight(key), out=best)
            symbol = np.where(best > 0, INSULT, self.closed.weight(w.hash).astype(np.int64))
            best[symbol == THREAT] = LISTED_WEIGHT
            ends = np.concatenate([[0], np.cumsum(_ENDS[own], dtype=np.int32)])[w.start]
            row = np.searchsorted(at, w.start, "right") - 1
            heads = np.flatnonzero(np.concatenate([[True], (ends[1:] != ends[:-1]) | (row[1:] != row[:-1])]))
            length = np.diff(np.append(heads, len(row)))
            clause = np.repeat(np.arange(len(heads)), length)
            hit = np.zeros(len(heads), dtype=bool)
            hit[clause[(symbol == INSULT) | (symbol == THREAT)]] = True
            score = np.zeros(len(heads))
            score[hit] = self.clauses(symbol, best, heads[hit], length[hit])
            out[a:b, 0] = np.log1p(np.bincount(row[heads], weights=score, minlength=b - a))
            out[a:b, 1] = np.bincount(row[heads], weights=score > 0, minlength=b - a) / np.maximum(np.bincount(row[heads], minlength=b - a), 1)
        return out

    def clauses(self, symbol: np.ndarray, value: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of clauses of words with these symbols and values, each read from its end and then from its start."""
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        state, read = np.zeros(len(begin), np.int64), symbol.copy()
        for t, n in enumerate(alive.tolist()):
            at = begin[:n] + length[:n] - 1 - t
            hits = at[(state[:n] == 1) & ((symbol[at] == INSULT) | (symbol[at] == THREAT))]
            read[hits] = symbol[hits] + (len(SYMBOLS) - INSULT)
            state[:n] = self.targets[state[:n], symbol[at]]
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin))
        for t, n in enumerate(alive.tolist()):
            at = begin[:n] + t
            total[:n] += self.weight[state[:n], read[at]] * value[at]
            state[:n] = self.next[state[:n], read[at]]
        out = np.zeros(len(begin))
        out[order] = total
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.features(column) @ self.curve[:-1] + self.curve[-1])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Min-wise hashes of each sampled text's word triples."""
    for batch in batches:
        data, offs = string_buffer(batch.column(1))
        keys = np.zeros((batch.num_rows, SKETCH), np.int64)
        for a, b in row_slices(offs):
            w = _cut(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            for i in range(b - a):
                h = w.hash[w.first[i] : w.first[i + 1]]
                h = h[2:] * U64(3) + h[1:-1] * U64(5) + h[:-2] * U64(7) if len(h) > 2 else h
                for k in range(SKETCH):
                    keys[a + i, k] = int(mix(h ^ U64(0x1234567 * (k + 1))).min() >> U64(1)) if len(h) else -1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([k.tobytes() for k in keys], pa.binary())], ["doc_id", "y", "sketch"])


def _independent(rows: list) -> dict[int, int]:
    """Labels of the sampled documents, by id, without those that are much like one before them."""
    kept: dict[int, int] = {}
    sketches, holders = [], [{} for _ in range(SKETCH)]
    for r in sorted(rows, key=lambda r: (int(mix(np.array([r.doc_id], np.int64).view(U64))[0]), r.doc_id)):
        sketch = np.frombuffer(r.sketch, np.int64)
        shared: dict[int, int] = {}
        for k, value in enumerate(sketch.tolist()):
            for other in holders[k].get(value, ()):
                shared[other] = shared.get(other, 0) + 1
        if max(shared.values(), default=0) < ALIKE:
            for k, value in enumerate(sketch.tolist()):
                holders[k].setdefault(value, []).append(len(sketches))
            sketches.append(sketch)
            kept[r.doc_id] = r.y
    return kept


def _counts(kinds: dict[int, int]):
    """Documents of each kind (2 x fold + label) that hold a key, summed within batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = string_buffer(batch.column(1))
            parts: list[list[np.ndarray]] = [[] for _ in range(2 * FOLDS)]
            for a, b in row_slices(offs):
                w = _cut(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                keys = list(_keyed(w))
                for i in range(b - a):
                    if (kind := kinds.get(ids[a + i])) is not None:
                        s = slice(w.first[i], w.first[i + 1])
                        parts[kind].append(np.unique(np.concatenate([k[s] for k in keys])))
            found = [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, U64), np.zeros(0, np.int64)) for p in parts]
            every = np.unique(np.concatenate([k for k, _ in found]))
            counts = np.zeros((2 * FOLDS, len(every)), np.int64)
            for kind, (k, n) in enumerate(found):
                counts[kind, np.searchsorted(every, k)] = n
            for k in range(0, len(every), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(every[s].view(np.int64)), *(pa.array(c[s]) for c in counts)], ["key", *(f"c{i}" for i in range(2 * FOLDS))])

    return run


def _strength(t, n, toxic: int, clean: int):
    """Weight and evidence of a key in t of ``toxic`` and n of ``clean`` documents, as columns."""
    p = toxic / (toxic + clean)
    weight = F.log((t + 0.5) / (toxic + 1.0)) - F.log((n + 0.5) / (clean + 1.0))
    evidence = F.when(t > 0, t * F.log(t / ((t + n) * p))).otherwise(0.0) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - p)))).otherwise(0.0)
    return weight, F.when((t >= DOCUMENTS) & (weight >= LEAST) & (evidence >= EVIDENCE + float(np.log(toxic + clean))), evidence)


def fit(documents: DataFrame, labels: DataFrame, held_out) -> Model:
    """The model of the labelled documents that are not held out."""
    sample = fitting.labelled_sample(documents, labels, "toxic", held_out, SAMPLE_ROWS)
    kept = _independent(sample.select("doc_id", "text", "y").mapInArrow(_sketches, "doc_id long, y int, sketch binary").collect())
    if len(set(kept.values())) < 2:
        return Model({})
    kinds = {d: 2 * (i % FOLDS) + y for i, (d, y) in enumerate(kept.items())}
    size = np.bincount(list(kinds.values()), minlength=2 * FOLDS)
    columns = [f"c{i}" for i in range(2 * FOLDS)]
    counts = sample.select("doc_id", "text").mapInArrow(_counts(kinds), "key long, " + ", ".join(f"{c} long" for c in columns)).groupBy("key").agg(*[F.sum(c).alias(c) for c in columns])
    total = {y: sum((F.col(c) for c in columns[y::2]), F.lit(0)) for y in (0, 1)}
    picked = [F.col("key")]
    for fold in (None, *range(FOLDS)):  # all, and all but one fold
        t, n = (total[y] - F.col(f"c{2 * fold + y}") if fold is not None else total[y] for y in (1, 0))
        toxic, clean = (int(size[y::2].sum() - (size[2 * fold + y] if fold is not None else 0)) for y in (1, 0))
        weight, evidence = _strength(t, n, max(1, toxic), max(1, clean))
        picked.append(F.when(evidence.isNotNull(), weight).alias("all" if fold is None else f"f{fold}"))
    strong = counts.where("key <> 0").select(*picked).where(F.coalesce("all", *(f"f{k}" for k in range(FOLDS))).isNotNull())
    entries = strong.collect()

    def lexicon(name: str) -> dict[int, float]:
        return {int(np.int64(r.key).view(U64)): float(r[name]) for r in entries if r[name] is not None}

    model, others = Model(lexicon("all")), [Model(lexicon(f"f{k}")) for k in range(FOLDS)]
    found = sample.select("doc_id", "text").mapInArrow(_featured(others, {d: k // 2 for d, k in kinds.items()}), "doc_id long, f0 double, f1 double").collect()
    found.sort(key=lambda r: r.doc_id)
    model.curve = fitting.logistic(np.array([(r.f0, r.f1) for r in found]), np.array([kept[r.doc_id] for r in found]), l2=0.05)
    return model


def _featured(models: list[Model], folds: dict[int, int]):
    """Features of the sampled documents, each by the model that has not seen it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.array([folds.get(d, -1) for d in batch.column(0).to_pylist()], np.int64)
            for k, model in enumerate(models):
                own = batch.filter(pa.array(fold == k))
                if own.num_rows:
                    f = model.features(own.column(1))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], ["doc_id", "f0", "f1"])

    return run


def _scores(model: Model, columns: list[str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(batch.column(batch.schema.get_field_index("text"))))
            kept = batch.select(columns) if columns else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, score], [*kept.schema.names, "score"])

    return run


HELD_OUT = fitting.remainder(4, 2)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")
    model = fit(documents, labels, HELD_OUT)
    scored = documents.select("doc_id", "text").mapInArrow(_scores(model, ["doc_id"]), "doc_id long, score double")
    return scored.select("doc_id", HELD_OUT(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(model: Model):
    """For mapInArrow over whole rows: those of documents that are not toxic."""
    score = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in score(batches):
            yield batch.filter(pa.compute.less(batch.column(batch.num_columns - 1), THRESHOLD)).select(list(range(batch.num_columns - 1)))

    return run
