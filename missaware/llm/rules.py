"""Quality rules with line labels from a linear-chain conditional random field.

Each line that has a word is content or boilerplate.  The field has one emission score per line
(a weighted sum of line features, for boilerplate against content) and one transition score (a line
tends to keep its neighbour's label); Viterbi decoding finds the best label sequence of the whole
text.  The share of words on content lines decides, after two base rules (length and repetition).
The weights are rules stated in ``CRF``, not fitted.

Each text is scored alone in Arrow batches: no shuffle, memory of one batch.

Defined results: a null or empty text has no words and fails the length rule; ties between label
sequences go to content; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SPACE = " \t\n\x0b\x0c\r"
#: Phrases of notices and navigation (fixed values): English, French, German, Spanish.
NOTICES = (
    "all rights reserved", "cookie", "copyright", "subscribe", "click here", "terms of use", "privacy policy", "sign in", "log in",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "abonnez-vous", "se connecter", "connectez-vous",
    "alle rechte vorbehalten", "impressum", "datenschutz", "nutzungsbedingungen", "hier klicken", "klicken sie hier", "newsletter abonnieren", "anmelden",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "condiciones de uso", "términos de uso", "haga clic aquí", "haz clic aquí", "suscríbete", "iniciar sesión",
)
#: Ends of a line that belongs to running text.
MARKS = (".", "!", "?", ":", ",", ";", "…", "。", "！", "？", "：", "，")


@dataclass(frozen=True)
class CRF:
    """Emission weights (added up for boilerplate, per line) and the transition score."""

    bias: float = -3.0
    symbols: float = 6.0  # symbol characters per word, at most 1
    shouting: float = 6.0  # share of capitals among ASCII letters, beyond a third
    bangs: float = 4.0  # "!!" per word, at most 1
    cells: float = 8.0  # " | " separators per word, at most a half
    repeated: float = 2.5  # the line equals an earlier one
    notice: float = 4.0  # holds a phrase of a notice; alone a positive score that ``stay`` outweighs
    fragment: float = 3.5  # otherwise: under four words and 60 bytes, no end mark; the same
    stay: float = 1.5  # neighbours with the same label
    min_content: float = 0.5  # least share of words on content lines


DEFAULT = CRF()


def viterbi(scores: list[float], stay: float) -> list[int]:
    """Best labels (1: boilerplate) where label 1 earns the line's score and equal neighbours ``stay``."""
    if not scores:
        return []
    zero, one, back = 0.0, scores[0], []
    for s in scores[1:]:
        from_one0, from_one1 = one > zero + stay, one + stay > zero
        back.append((from_one0, from_one1))
        zero, one = (one if from_one0 else zero + stay), (one + stay if from_one1 else zero) + s
    label = int(one > zero)
    out = [label]
    for b in reversed(back):
        label = int(b[label])
        out.append(label)
    return out[::-1]


def line_score(line: str, n_words: int, repeated: bool, crf: CRF) -> float:
    raw = line.encode("utf-8", "replace")
    size = len(raw)
    up, low = size - len(raw.translate(None, UPPER)), size - len(raw.translate(None, LOWER))
    score = crf.bias + crf.symbols * min(1.0, (size - len(raw.translate(None, SYMBOLS))) / n_words)
    if up + low >= 4:
        score += crf.shouting * max(0.0, up / (up + low) - 1 / 3)
    score += crf.bangs * min(1.0, raw.count(b"!!") / n_words)
    score += crf.cells * min(0.5, raw.count(b" | ") / n_words)
    if repeated:
        score += crf.repeated
    if n_words < 30 and any(p in line.lower() for p in NOTICES):
        score += crf.notice
    elif n_words < 4 and size < 60 and not line.rstrip().endswith(MARKS):
        score += crf.fragment
    return score


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    pair = a[:-2] * m + a[1:-1]
    if m >= 1 << 20:  # keep the code of three words below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * m + a[2:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def measure(text: str | None, crf: CRF = DEFAULT) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words, base_failed, kept."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS.decode()))
    dup, content, seen, scores, sizes = 0, 0, set(), [], []
    for line in text.split("\n"):
        k = len(line.encode("utf-8", "replace").split())
        if k:
            again = line in seen
            dup += again
            seen.add(line)
            sizes.append(k)
            scores.append(line_score(line, k, again, crf))
    for k, label in zip(sizes, viterbi(scores, crf.stay), strict=True):
        if not label:
            content += k
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, symbols, dup, repeats, content, failed, not failed and content >= crf.min_content * n


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("content_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: CRF = DEFAULT) -> DataFrame:
    """Measures and verdict of every row: the id column and ``FIELDS``."""

    def run(batches):
        for b in batches:
            cols = list(zip(*[measure(t, crf) for t in b.column(1).to_pylist()], strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)]], [id_col, *[k for k, _ in FIELDS]])

    one = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return one.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {DDL}")


def keep(docs: DataFrame, text_col: str = "text", crf: CRF = DEFAULT) -> DataFrame:
    """The rows that pass, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([measure(t, crf)[-1] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir):
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
