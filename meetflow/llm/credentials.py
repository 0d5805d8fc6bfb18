"""Secret scans: base patterns, and formats learned by grammar inference (state merging)."""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .text import pieces

KINDS = ("assign", "access", "hex")
#: What a learned automaton finds.
LEARNED = "format"
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")  # on bytes with A-Z lowered
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Candidates for the learned formats: runs of this alphabet, at least so long, and their parts between glue.
ALPHABET, SHORTEST = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", 8
GLUE = b"=/._-"

#: Symbols of the automata: classes of characters.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "A", "K", "I", "BCDEF", "GHJLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
SYMBOL = np.zeros(256, np.int8)
for _i, _c in enumerate(CLASSES):
    SYMBOL[list(_c.encode())] = _i


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True, at least so long."""
    d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    long = e - s >= least
    return s[long], e[long]


def table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def candidates(open_: np.ndarray, taken: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates: what base spans leave of each run, and its pieces between all glue and between each kind of it."""
    free = open_ & ~taken
    found = []
    for glue in (b"", GLUE, *(GLUE[i : i + 1] for i in range(len(GLUE)))):
        s, e = runs(free & ~table(glue)[sep], SHORTEST)
        found.append(s << 32 | e)
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def apart(hits: list[tuple]) -> list[tuple]:
    """Of (- score, start, end) that overlap, the likeliest; of equals the longest."""
    out = []
    for _, s, e in sorted(hits, key=lambda x: (x[0], x[1] - x[2], x[1])):
        at = bisect.bisect(out, (s, e))
        if (at == 0 or out[at - 1][1] <= s) and (at == len(out) or out[at][0] >= e):
            out.insert(at, (s, e))
    return out


def scan(column):
    """For each piece of documents (first row, row after the last) their base spans, and the other candidates with their documents and strings."""
    is_hex, is_cand, is_cont = table(b"0123456789abcdef"), table(ALPHABET), np.zeros(256, bool)
    is_cont[128:192] = True
    for lo, hi, buf, off in pieces(column):
        n = hi - lo
        # a zero byte after every document: no pattern crosses it
        sep = np.zeros(len(buf) + n, np.uint8)
        shift = np.repeat(np.arange(n), np.diff(off))
        sep[np.arange(len(buf)) + shift] = buf
        raw = sep.tobytes()
        begin = off[:-1] + np.arange(n)
        points = np.concatenate([[0], np.cumsum(~is_cont[sep])])
        found = []
        found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 8]
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
        found += [(s, e, 2, s) for s, e in zip(*(x.tolist() for x in runs(is_hex[sep], 32)))]
        found.sort(key=lambda x: (x[0], x[2]))
        doc = np.searchsorted(begin, [x[0] for x in found], "right") - 1
        spans = [[] for _ in range(n)]
        taken = np.zeros(len(sep) + 1, np.int32)
        for (s, e, k, v), d in zip(found, doc):
            p = points[begin[d]]
            spans[d].append({"kind": k, "start": int(points[s] - p), "end": int(points[e] - p), "value": raw[v:e].decode()})
            taken[s] += 1
            taken[e] -= 1
        s, e = candidates(is_cand[sep], np.cumsum(taken[:-1]) > 0, sep)
        doc = np.searchsorted(begin, s, "right") - 1
        zero = points[begin[doc]]
        yield lo, hi, spans, doc.tolist(), (points[s] - zero).tolist(), (points[e] - zero).tolist(), [raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist())]


def strings(batches):
    """The different strings of each piece: of base spans by kind, and of candidates (after the kinds)."""
    for batch in batches:
        for _, _, spans, _, _, _, values in scan(batch.column("_text")):
            known = {(x["kind"], x["value"]) for row in spans for x in row} | {(len(KINDS), v) for v in values}
            k, v = zip(*sorted(known)) if known else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v, pa.string())], ["kind", "value"])


def learn_automaton(strings: list[str], alpha: float = 0.05, least: int = 8) -> dict:
    """A probabilistic automaton by state merging (ALERGIA's red-blue order) over character classes.

    The prefix tree counts arrivals, ends and moves.  A blue state joins the red
    state it differs from least, if their end and move frequencies and those of
    all states below agree within Hoeffding's bound; states seen fewer than
    ``least`` times agree with any.  Otherwise it turns red.  Probabilities are
    smoothed; symbols never seen in a state lead to a sink of equal probabilities.
    """
    S = len(CLASSES)
    kids: list[dict] = [{}]
    moves: list[dict] = [{}]
    ends, seen, depth = [0], [0], [0]
    for text in strings:
        q = 0
        seen[0] += 1
        for a in SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist():
            moves[q][a] = moves[q].get(a, 0) + 1
            if a not in kids[q]:
                kids[q][a] = len(kids)
                kids.append({}), moves.append({}), ends.append(0), seen.append(0), depth.append(depth[q] + 1)
            q = kids[q][a]
            seen[q] += 1
        ends[q] += 1
    c = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(p: int, q: int) -> float:
        """The largest difference of frequencies over its bound, or infinity."""
        worst, todo = 0.0, [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = seen[p], seen[q]
            if min(n, m) < least:
                continue
            bound = c * (n**-0.5 + m**-0.5)
            for a in {*moves[p], *moves[q], -1}:
                x = ends[p] / n if a < 0 else moves[p].get(a, 0) / n
                y = ends[q] / m if a < 0 else moves[q].get(a, 0) / m
                worst = max(worst, abs(x - y) / bound)
            if worst > 1:
                return math.inf
            todo += [(kids[p][a], kids[q][a]) for a in kids[p] if a in kids[q] and kids[p][a] != kids[q][a]]
        return worst

    def fold(p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            seen[p] += seen[q]
            ends[p] += ends[q]
            for a, k in moves[q].items():
                moves[p][a] = moves[p].get(a, 0) + k
            for a, k in kids[q].items():
                if a in kids[p]:
                    todo.append((kids[p][a], k))
                else:
                    kids[p][a] = k

    red = [0]
    is_red = {0}
    while True:
        blue = [(-seen[k], k, q, a) for q in red for a, k in kids[q].items() if k not in is_red]
        if not blue:
            break
        _, k, q, a = min(blue)
        best = min(((differ(r, k), r) for r in red), default=(math.inf, -1)) if seen[k] >= least else (0.0, min(red, key=lambda r: (abs(depth[r] - depth[k]), r)))
        if best[0] <= 1:
            kids[q][a] = best[1]
            fold(best[1], k)
        else:
            red.append(k)
            is_red.add(k)
    number = {r: i for i, r in enumerate(red)}
    to = np.full((len(red) + 1, S), len(red), np.int32)
    p, stop = np.full((len(red) + 1, S), 1.0 / (S + 1)), np.full(len(red) + 1, 1.0 / (S + 1))
    for r, i in number.items():
        n = seen[r] + 0.02 * (S + 1)
        p[i], stop[i] = 0.02 / n, (ends[r] + 0.02) / n
        for a, k in moves[r].items():
            p[i, a] = (k + 0.02) / n
            to[i, a] = number.get(kids[r][a], len(red))
    return {"to": to, "p": np.log(p), "stop": np.log(stop)}


def transitions(batches):
    """How often one class of characters follows another in the strings; S stands before and after a string."""
    S = len(CLASSES)
    for batch in batches:
        _, _, buf, off = next(pieces(batch.column("value"), 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        ends = off[1:] + np.arange(len(off) - 1)
        row = np.full(len(buf) + len(off) - 1, S)
        row[np.arange(len(buf)) + np.repeat(np.arange(len(off) - 1), np.diff(off))] = SYMBOL[buf]
        n = np.bincount(np.concatenate([[S], row[:-1]]) * (S + 1) + row, minlength=(S + 1) ** 2) if len(ends) else np.zeros((S + 1) ** 2, np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["at", "n"])


def learn_background(counts: dict[int, int]) -> dict:
    """First-order chain over character classes: what other candidates look like, from their counted transitions."""
    S = len(CLASSES)
    n = np.full((S + 1) ** 2, 0.1)
    for at, k in counts.items():
        n[at] += k
    n = n.reshape(S + 1, S + 1)
    n /= n.sum(axis=1, keepdims=True)
    return {"to": np.tile(np.arange(S, dtype=np.int32), (S + 1, 1)), "p": np.log(n[:, :S]), "stop": np.log(n[:, S]), "from": S}


def likelihood(model: dict, strings: list[str]) -> np.ndarray:
    """Log probability of each string, all strings a symbol at a time."""
    size = np.array([len(x) for x in strings], np.int64)
    if not len(size):
        return np.zeros(0)
    order = np.argsort(-size, kind="stable")
    flat = SYMBOL[np.frombuffer("".join(strings).encode(), np.uint8)]
    begin = (np.cumsum(size) - size)[order]
    long = size[order]
    q, out = np.full(len(size), model.get("from", 0), np.int32), np.zeros(len(size))
    for t in range(int(long[0])):
        n = int(np.searchsorted(-long, -t, "left"))  # those with more than t symbols
        a = flat[begin[:n] + t]
        out[:n] += model["p"][q[:n], a]
        q[:n] = model["to"][q[:n], a]
    out += model["stop"][q]
    back = np.empty_like(out)
    back[order] = out
    return back


def score_strings(strings: list[str], models: dict) -> np.ndarray:
    """Log odds of the likeliest learned format against the background."""
    if not models["formats"] or not strings:
        return np.full(len(strings), -np.inf)
    return np.max([likelihood(m, strings) for m in models["formats"]], axis=0) - likelihood(models["background"], strings)


def scored(batches, models: dict):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(score_strings(batch.column("value").to_pylist(), models), pa.float64())], ["score"])


#: Bins of a histogram of scores, and the values that are at last sorted on the driver.
BINS, FEW = 4096, 10_000


def order_statistic(scores: DataFrame, rank: int) -> float:
    """The score with so many below it in order (exact): histograms of ever smaller ranges, counted in Spark."""
    lo, hi, n = scores.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    while n > FEW and lo < hi:
        width = (hi - lo) / BINS
        where = F.least(F.floor((F.col("score") - lo) / width), F.lit(BINS - 1)).alias("bin")
        bins = scores.groupBy(where).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
        for b in sorted(bins, key=lambda r: r["bin"]):
            if rank < b["n"]:
                break
            rank -= b["n"]
        lo, hi, n = b["lo"], b["hi"], b["n"]
        scores = scores.where((F.col("score") >= lo) & (F.col("score") <= hi))
    return lo if lo == hi else scores.orderBy("score").collect()[rank]["score"]


def quantile(scores: DataFrame, q: float) -> float:
    """As numpy.quantile, over a table."""
    at = (scores.count() - 1) * q
    low = order_statistic(scores, int(at))
    return low + (order_statistic(scores, math.ceil(at)) - low) * (at - int(at))


def fit(texts: DataFrame, *, most: int = 600, fewest: int = 8) -> dict:
    """An automaton for each kind with ``fewest`` or more labelled strings, from at most ``most`` different ones, those with the smallest hashes.

    The background chain counts the transitions of all different candidates.  The
    threshold lets through 98 of 100 labelled strings, but is at least 10 (nats)
    and above all but one in 10,000 of all different candidates' scores as far as
    the first condition leaves room.
    """
    known = cut(texts.mapInArrow(strings, "kind int, value string").distinct())
    labelled = [[r["value"] for r in known.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(most).collect()] for k in range(len(KINDS))]
    others = known.where(F.col("kind") == len(KINDS)).select("value")
    counts = others.mapInArrow(transitions, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    models = {"formats": [learn_automaton(x) for x in labelled if len(x) >= fewest], "background": learn_background({r["at"]: r["n"] for r in counts.collect()})}
    if not models["formats"]:
        return models | {"least": math.inf}
    low = np.quantile(score_strings([y for x in labelled for y in x], models), 0.02)
    held = texts.sparkSession.sparkContext.broadcast(models)
    scores = cut(others.mapInArrow(lambda it: scored(it, held.value), "score double"))
    high = quantile(scores, 0.9999) if scores.limit(1).count() else 10.0
    return models | {"least": float(max(10.0, min(low, high)))}


def find(batches, id_col: str, models: dict):
    text = lambda rows: ",".join(f"{(*KINDS, LEARNED)[k]}:{s}:{e}" for s, k, e in sorted(rows))
    for batch in batches:
        counts, digest, spans, odds = [[], [], []], [], [], []
        for _, _, base, doc, start, end, values in scan(batch.column("_text")):
            different = {v: i for i, v in enumerate(dict.fromkeys([*values, *(x["value"] for b in base for x in b)]))}
            score = score_strings(list(different), models)
            hits = [[] for _ in base]
            for d, s, e, v in zip(doc, start, end, values):
                if score[different[v]] >= models["least"]:
                    hits[d].append((-score[different[v]], s, e))
            for b, h in zip(base, hits):
                own = [(x["start"], x["kind"], x["end"]) for x in b]
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in own))
                digest.append(hashlib.sha256(text(own).encode()).hexdigest())
                more = apart(h)
                spans.append(text(own + [(s, len(KINDS), e) for s, e in more]))
                of = {(s, e): -x for x, s, e in h}
                rows = [(x["start"], x["kind"], x["end"], score[different[x["value"]]]) for x in b] + [(s, len(KINDS), e, of[s, e]) for s, e in more]
                odds.append([float(x[3]) for x in sorted(rows)])
        yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(x, pa.int64()) for x in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(odds, pa.list_(pa.float64()))],
                                         [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "log_odds"])


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 600) -> DataFrame:
    """Secrets of every whole text.

    One pass finds the different strings of base spans and of all other runs of 8
    or more credential characters, whole and in pieces between ``= / . _ -`` (all,
    and each alone), without what base spans cover; the strings that the base patterns found are
    the labelled credentials (a bounded sample reaches the driver), automata are
    inferred from them by state merging, and background and threshold from all
    other candidates.  A second pass scores every candidate in its
    place, and of candidates that overlap takes the likeliest.

    Returns id, counts and digest of the base spans, all spans as
    ``kind:start:end`` (code points), and in the same order ``log_odds``: how much
    likelier (nats) the likeliest learned format makes each span's value than the
    background, -infinity where nothing was learned.  Null and empty texts have no spans;
    repeated rows and null ids give a row each; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    models = fit(src.select("_text"), most=most)
    held = docs.sparkSession.sparkContext.broadcast(models)  # a few hundred states
    out = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, log_odds array<double>"
    return src.mapInArrow(lambda it: find(it, id_col, held.value), out)
