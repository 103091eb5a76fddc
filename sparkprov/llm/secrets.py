"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more characters of [A-Za-z0-9+/_=-]; private key blocks from BEGIN to END; three such runs
that dots join (web tokens); values of any length and character after a word that
speaks for a secret and =, : or "is", or after "Bearer" (in quotes: all within; else up to white space, and up to the
first of ``,;&`` too); and what stands between user: and @host.  Candidates may overlap.  The forest sees its length, shares of
character classes, transitions between classes, entropy, the share that dictionary words cover, the path it comes from
and the words around it.  The dictionary is the corpus's own: its ``WORDS`` most frequent words of four letters or more,
counted over all documents, beside a few fixed ones.  It learns from labelled findings; as the tables have none, ``made_findings`` makes them from a
seed (keys, tokens and passwords beside numbers, digests, identifiers, paths, rules and plain values).

Null and empty texts have no findings; a null path counts as empty; repeated rows give repeated findings; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
BLOCKS = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----")
DOTTED = re.compile(r"\b[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2}")
NEAR = 40
#: Words of the dictionary at most, and the letters that one has.
WORDS = 8192
LETTERS = (4, 14)
SET = re.compile(r"[=:]+>?(?:\s*[\"']?bearer\s)?|\b(?:is|bearer)\s", re.I)
NAME = re.compile(r"([\w\-]+)[\"'\]]*\s*$")
VALUE = re.compile(r"""\s*(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?([^\s"',;&][^\s,;&]*))""")
RUN = re.compile(r"\S+")
ENDS = ".,;:)]}>\"'"
#: Parts of names whose values are candidates, words that speak for a secret, words that speak against one, parts of paths that do, plain words and parts of long ones.
NAMES = ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "bearer", "credential", "private", "access")
FOR = ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access")
AGAINST = ("sha", "checksum", "commit", "hash", "uuid", "guid", "version", "revision", "build", "example", "sample", "test", "dummy", "etag", "digest", "card", "phone", "order", "invoice")
PATHS = ("test", "example", "doc", "fixture", "mock", "sample")
PLAIN = ("the", "and", "for", "with", "from", "data", "file", "name", "user", "test", "time", "this", "that", "main", "list", "item", "page", "image", "index", "value", "table", "config", "server", "client", "report", "static", "module", "function", "request", "response")

SYLLABLES = ("er", "sch", "ber", "tion", "men", "ta", "ver", "ein", "gen", "lo", "qui", "ra", "ment", "ne", "si", "ung", "des", "au")


def dictionary(docs: DataFrame, size: int = WORDS) -> frozenset[str]:
    """The most frequent words of all documents, ties by code point; ``size`` bounds what reaches the driver.

    A quantile of the counts, low enough to stand below the last word wanted, leaves out rare words before any are sorted.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    words = words.where(F.char_length("w").between(*LETTERS)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words, accuracy = cut(words, "secrets-words"), 100_000
    if (many := words.count()) > 2 * size:
        share = max(0.0, 1 - (size + 2 * many / accuracy + 1) / many)
        words = words.where(F.col("n") >= words.agg(F.percentile_approx("n", share, accuracy)).first()[0])
    return frozenset(r["w"] for r in words.orderBy(F.desc("n"), "w").limit(size).collect()) | frozenset(PLAIN)


def covered(low: str, words: frozenset[str]) -> np.ndarray:
    """Marks the characters that stand in a dictionary word."""
    out = np.zeros(len(low), bool)
    for i in range(len(low)):
        for j in range(min(len(low), i + LETTERS[1]), i + 2, -1):
            if low[i:j] in words:
                out[i:j] = True
                break
    return out


def features(found: str, before: str, after: str, path: str, words: frozenset[str] = frozenset(PLAIN)) -> list[float]:
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in found]
    n = len(found)
    counts = np.bincount(kinds, minlength=4) / n
    moves = np.zeros((4, 4))
    np.add.at(moves, (kinds[:-1], kinds[1:]), 1 / max(n - 1, 1))
    share = np.unique(list(found), return_counts=True)[1] / n
    near = re.findall(r"[a-z_]+", before.lower())[-4:]
    near = " ".join(near) + " " + " ".join(re.findall(r"[a-z_]+", after.lower())[:2])
    return [
        n, *counts, moves[0, 2] + moves[2, 0], moves[0, 1] + moves[1, 0], moves[1, 2] + moves[2, 1], moves[3].sum(), moves[2, 2],
        float(-(share * np.log2(share)).sum()), covered(found.lower(), words).mean(), float(all(c in "0123456789abcdefABCDEF" for c in found)),
        sum(w in near for w in FOR), sum(w in near for w in AGAINST), float(before.rstrip(" \"'").endswith(("=", ":"))), float(before.endswith(('"', "'"))), sum(w in path.lower() for w in PATHS),
    ]


def made_findings(n: int = 5000, seed: int = 11, words: frozenset[str] = frozenset(PLAIN)) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings: (features, 1 for a secret); half of the plain words come from the dictionary."""
    rng = np.random.default_rng(seed)
    own = [*PLAIN, *rng.choice(sorted(words), len(PLAIN))]
    letters = {"hex": "0123456789abcdef", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "digits": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    letters["any"] = letters["alnum"] + "!#$%^&*?@+-_." * 2

    def draw(kind: str, k: int) -> str:
        return "".join(rng.choice(list(letters[kind]), k))

    def prose() -> str:
        return " ".join(rng.choice(own, 4))

    rows, y = [], []
    for i in range(n):
        word, bad = str(rng.choice(FOR)), str(rng.choice(AGAINST))
        path = str(rng.choice(["src/app/settings.py", "deploy/prod.env", "src7", "src12", "notes.txt"]))
        form = f"{prose()} {word} {rng.choice(['=', ':', '= ', ': '])}{rng.choice(['', chr(34), chr(39)])}"
        kind = int(rng.integers(0, 18))
        if kind in (12, 13):
            secret = draw("any", int(rng.integers(4, 24))) if rng.random() < 0.7 else str(rng.choice(own)).title() + draw("digits", int(rng.integers(2, 5))) + str(rng.choice(list("!#$?@")))
            row = (secret, form if kind == 12 else f"{prose()} {rng.choice(['postgres://', 'https://', 'amqp://', ''])}{rng.choice(own)}:", '" ' + prose() if kind == 12 else f"@{rng.choice(own)}.{rng.choice(own)}/", path)
        elif kind in (14, 15):
            plain = str(rng.choice([str(rng.choice(own)), draw("digits", int(rng.integers(1, 6))), "required", "none", " ".join(map(str, rng.choice(own, 3))), str(rng.choice(own)).title() + "."]))
            if kind == 15:
                plain = [str(rng.choice(list("=-_/+"))) * int(rng.integers(16, 60)), "".join(str(w).title() for w in rng.choice(own, 5)), "_".join(map(str, rng.choice(own, 5))), "-".join(map(str, rng.choice(own, 5))), str(rng.choice(["a", "x", "ab"])) * 20, "".join(map(str, rng.choice(SYLLABLES, 7))), "".join(map(str, rng.choice(SYLLABLES, 7))).upper()][int(rng.integers(0, 7))]
            row = (plain, form if kind == 14 or rng.random() < 0.2 else prose() + " ", " " + prose(), path)
        elif kind == 16:
            head = str(rng.choice(["", "RSA ", "EC ", "OPENSSH "])) + "PRIVATE KEY"
            body = "\n".join(draw("alnum", 64) for _ in range(int(rng.integers(1, 8))))
            block = f"-----BEGIN {head}-----\n{body}\n-----END {head}-----"
            row = (block, prose() + "\n", "\n" + prose(), path)
        elif kind == 17:
            dotted = rng.random() < 0.5
            parts = [draw("alnum", int(rng.integers(20, 80))) for _ in range(2)]
            words = ".".join(str(rng.choice(SYLLABLES)) + str(rng.choice(own)) + str(rng.choice(SYLLABLES)) for _ in range(3))
            row = ("eyJ" + ".".join([draw("alnum", 17), *parts]) if dotted else words, form if dotted else prose() + " ", " " + prose(), path)
        elif kind < 5:
            secret = [draw("hex", int(rng.choice([32, 40, 64]))), draw("alnum", int(rng.integers(20, 64))), "AKIA" + draw("upper", 16), "ghp_" + draw("alnum", 36), "sk-" + draw("alnum", 48)][kind]
            row = (secret, form if kind < 2 or rng.random() < 0.6 else prose() + " ", '" ' + prose(), path)
        else:
            plain = [
                draw("digits", int(rng.integers(16, 20))), draw("hex", int(rng.choice([32, 40, 64]))), "-".join(draw("hex", k) for k in (8, 4, 4, 4, 12)),
                "/".join(map(str, rng.choice(own, 4))) + "/" + draw("digits", 4), "_".join(map(str, rng.choice(own, 3))) + draw("digits", 3), "-".join(draw("digits", 4) for _ in range(4)), draw("hex", 40),
            ][kind - 5]
            row = (plain, f"{prose()} {bad} {rng.choice(['', '= ', ': '])}" if kind in (6, 7, 11) else prose() + " ", " " + prose(), path if kind != 11 else "tests/fixture.txt")
        rows.append(features(*row, words))
        y.append(float(kind < 5 or kind in (12, 13, 16) or kind == 17 and dotted))
    return np.array(rows), np.array(y)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 5) -> Forest:
        rng, out = np.random.default_rng(seed), []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []

            def grow(at: np.ndarray, level: int) -> int:
                me = len(nodes)
                share = float(y[at].mean())
                nodes.append([-1, 0.0, -1, -1, share])
                if level == depth or share in (0.0, 1.0) or len(at) < 8:
                    return me
                best = (share * (1 - share) * len(at) - 1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
                    for cut_at in np.unique(np.quantile(x[at, f], np.linspace(0.05, 0.95, 15))):
                        left = x[at, f] <= cut_at
                        a, b = int(left.sum()), int((~left).sum())
                        if a and b:
                            p, q = y[at][left].mean(), y[at][~left].mean()
                            best = min(best, (p * (1 - p) * a + q * (1 - q) * b, int(f), float(cut_at)))
                if best[1] >= 0:
                    left = x[at, best[1]] <= best[2]
                    nodes[me][:2] = best[1], best[2]
                    nodes[me][2] = grow(at[left], level + 1)
                    nodes[me][3] = grow(at[~left], level + 1)
                return me

            grow(rows, 0)
            table = np.array(nodes)
            out.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))
        return cls(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut_at, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut_at[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, every span once, in order."""
    spans = {m.span() for found in (CANDIDATE, DOTTED) for m in found.finditer(text)}
    spans |= {m.span() for m in BLOCKS.finditer(text)} if "PRIVATE KEY" in text else set()
    at = end = 0
    while m := SET.search(text, at):
        at = m.end()
        name = NAME.search(text[max(0, m.start() - NEAR) : m.start()])
        if not (m.group()[-1].isspace() and "bearer" in m.group().lower() or name and any(w in name[1].lower() for w in NAMES)):
            continue
        if v := VALUE.match(text, at):
            a, b = v.span(v.lastindex)
            at = v.end()
            if v.lastindex < 3:
                spans.add((a, b))
                continue
            spans.add((a, a + len(text[a:b].rstrip(ENDS)) or b))
            if a >= end:  # the whole run, once
                end = RUN.match(text, a).end()
                spans.add((a, a + len(text[a:end].rstrip(ENDS))))
    for m in RUN.finditer(text) if "@" in text else ():
        if "@" not in m.group():
            continue
        pieces, start = m.group().split("://"), m.start()
        for i, piece in enumerate(pieces):
            a, b = piece.find(":") + 1, piece.rfind("@")
            if 0 < a < b and (i or len(pieces) == 1):
                spans.add((start + a, start + b))
            start += len(piece) + 3
    return sorted(x for x in spans if x[0] < x[1])


def scan_text(text: str, path: str, words: frozenset[str] = frozenset(PLAIN)) -> list[tuple[int, int, list[float]]]:
    """(start, length, features) of each candidate."""

    def seen(a: int, b: int) -> list[float]:
        return features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], path, words)

    return [(a, b - a, seen(a, b)) for a, b in candidates(text)]


def find_secrets(
    docs: DataFrame, forest: Forest, path: str = "source", least: float = 0.5, words: frozenset[str] = frozenset(PLAIN)
) -> DataFrame:
    """(doc_id, start, length, score, secret): every candidate in every whole text, in code points.

    ``words`` is the dictionary that the forest learnt with.
    """
    shared = docs.sparkSession.sparkContext.broadcast((forest, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (trees, known), (ids, starts, lengths, rows) = shared.value, ([], [], [], [])
            for doc, text, where in zip(*(b.column(i).to_pylist() for i in range(3))):
                for start, length, x in scan_text(text or "", where or "", known):
                    ids.append(doc)
                    starts.append(start)
                    lengths.append(length)
                    rows.append(x)
            scores = trees.score(np.array(rows)) if rows else np.zeros(0)
            longs = [pa.array(x, pa.int64()) for x in (ids, starts, lengths)]
            columns = [*longs, pa.array(scores, pa.float64()), pa.array(scores >= least, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "score", "secret"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(path).alias("path"))
    return rows.mapInArrow(scan, "doc_id long, start long, length long, score double, secret boolean")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = dictionary(docs)
    return find_secrets(docs, Forest.train(*made_findings(words=words)), words=words)


QUERIES, SQL = {"op5_secrets": op5_secrets}, {}
