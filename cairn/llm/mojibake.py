"""Finding and restoring text that was decoded with a wrong character encoding (problem 8).

A multinomial classifier over hashed byte bigrams predicts for every word the chain of wrong decodings it
went through, if any. It is trained on words of the corpus garbled by every chain; the words of a bounded
sample of documents are the labelled rows, cleared of words that are garbled themselves. The predicted
chain is inverted and the word counts as found only if every step of the inverse decodes strictly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Documents whose words train the classifier, at most; all documents are judged.
SAMPLE_DOCUMENTS = 8000
BUCKETS = 1 << 14
#: Steps (encoding the bytes were in, encoding they were read as), innermost first.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    (("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1256"),), (("utf-8", "cp1251"),), (("utf-8", "mac_roman"),), (("utf-8", "cp437"),), (("utf-8", "cp850"),),
    (("cp1256", "latin-1"),), (("cp1256", "cp1252"),), (("cp1256", "cp1251"),), (("cp1254", "latin-1"),), (("cp1254", "cp1252"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "latin-1")), (("utf-8", "latin-1"), ("utf-8", "cp1252")), (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
]
LOST = "�"
#: Probability from which a word counts as garbled.
CERTAIN = 0.9
#: What strict decoding of several bytes as UTF-8 adds to the log odds: clean text hardly ever has that form.
STRICT_BONUS = 6.0
_GAPS = re.compile(r"[ \t\r\n]+")


def _holes(codec: str) -> tuple[dict[int, int], dict[str, int]]:
    decode = {}
    for b in range(256):
        try:
            decode[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            decode[b] = b  # read as the control character of that number, as browsers do
    return decode, {chr(c): b for b, c in decode.items()}


_TABLES = {codec: _holes(codec) for chain in CHAINS for step in chain for codec in step if codec != "utf-8"}


def misread(text: str, step: tuple[str, str]) -> str | None:
    """text written in one encoding and read as another; None if it cannot be written in the first."""
    written, read = step
    try:
        data = text.encode(written)
    except UnicodeEncodeError:
        return None
    return data.decode("utf-8", "replace") if read == "utf-8" else "".join(chr(_TABLES[read][0][b]) for b in data)


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, or None where a step cannot be undone strictly."""
    for written, read in reversed(chain):
        back = _TABLES[read][1]
        try:
            text = bytes(back[c] for c in text).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for step in chain:
        out = misread(text, step)
        if out is None:
            return None
        text = out
    return text


def _script(c: str) -> str:
    return "arabic" if "\u0600" <= c <= "\u06ff" else "cyrillic" if "\u0400" <= c <= "\u052f" else "greek" if "\u0370" <= c <= "\u03ff" else "latin" if c < "\u0250" else "other"


def plausible(text: str) -> bool:
    """No control, private or unassigned characters, and letters of one script only."""
    return all(unicodedata.category(c) not in ("Cc", "Co", "Cn", "Cs") for c in text) and len({_script(c) for c in text if c.isalpha()}) <= 1


def bigrams(word: str) -> list[int]:
    """Buckets of the byte bigrams of a word that touch a byte above 127."""
    data = b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03"
    return [((a << 8 | b) * 2654435761 >> 7) % BUCKETS for a, b in zip(data, data[1:]) if a > 127 or b > 127]


@dataclass
class Classifier:
    weights: np.ndarray  # [class, bucket] log probabilities; class 0 is clean, k is CHAINS[k - 1]
    prior: np.ndarray  # [class] log probabilities

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(words), 1))
        for k, word in enumerate(words):
            grams = bigrams(word)
            if grams:
                out[k] += self.weights[:, grams].sum(axis=1)
        return out

    def looks_clean(self, word: str) -> bool:
        """Whether most bigrams of a word were seen in clean text."""
        grams = bigrams(word)
        return not grams or float((self.weights[0, grams] > self.weights[0].min() + 0.7).mean()) > 0.7

    def judge(self, words: list[str]) -> list[tuple[int, str | None]]:
        """(class, restored) of each word: 0 if clean, the number of the chain if found and undone, -1 if found but lost."""
        out: list[tuple[int, str | None]] = []
        for word, score in zip(words, self.scores(words)):
            if LOST in word:
                out.append((-1, None))
                continue
            best, text, odds, rest = 0, None, score[0], []
            for k in np.argsort(-score[1:]) + 1:
                undone = invert(word, CHAINS[k - 1])
                if undone is None or undone == word or not undone or not plausible(undone):
                    continue
                now = score[k] + (STRICT_BONUS if CHAINS[k - 1][-1][0] == "utf-8" and self.looks_clean(undone) else 0.0)
                rest.append(now)
                if now > odds:
                    best, text, odds = int(k), undone, now
            if best:
                share = 1 / (1 + np.exp(np.clip(score[0] - np.logaddexp.reduce(rest), -700, 700)))
                if share < CERTAIN:
                    best, text = 0, None
            out.append((best, text))
        return out


def train(counts: dict[str, int], rounds: int = 2, smoothing: float = 0.05, clean_prior: float = 0.9) -> Classifier:
    """Train on words with their counts, most of them clean; words that are garbled themselves are cleared out."""
    prior = np.log(np.array([clean_prior] + [(1 - clean_prior) / len(CHAINS)] * len(CHAINS)))

    def fitted(words: dict[str, int]) -> Classifier:
        table = np.full((len(CHAINS) + 1, BUCKETS), smoothing)
        for word, n in words.items():
            np.add.at(table[0], bigrams(word), n)
            for k, chain in enumerate(CHAINS, 1):
                wrong = garble(word, chain)
                if wrong is not None and wrong != word:
                    np.add.at(table[k], bigrams(wrong), n)
        return Classifier(np.log(table / table.sum(axis=1, keepdims=True)), prior)

    counts = {w: n for w, n in counts.items() if LOST not in w}
    undone = {w: [u for c in CHAINS if c[-1][0] == "utf-8" and (u := invert(w, c)) and u != w and plausible(u)] for w in counts}
    model = fitted({w: n for w, n in counts.items() if not undone[w]})
    # a word that decodes strictly is taken for clean only if nothing it decodes to looks like the corpus
    words = {w: n for w, n in counts.items() if not any(model.looks_clean(u) for u in undone[w])}
    for _ in range(rounds):
        model = fitted(words)
        listed = list(words)
        words = {w: words[w] for w, (k, _) in zip(listed, model.judge(listed)) if k == 0}
    return model


def _words(text: str) -> list[str]:
    return [w for w in _GAPS.split(text) if w and not w.isascii()]


def trained_on(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Classifier:
    """The classifier for a corpus, from the words of at most about sample documents drawn by a hash of their id and text."""
    texts = documents.where("text is not null").select("doc_id", "text")
    total = texts.count()
    if total > sample:
        share = int(sample / total * (1 << 53))
        if not share:
            raise ValueError("the sample is too small a share of the corpus to be drawn")
        texts = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 53)) < share)
    words = texts.select(F.explode(F.array_distinct(F.split("text", r"[ \t\r\n]+"))).alias("w")).where(F.col("w").rlike(r"[^\x00-\x7F]"))
    rows = words.groupBy("w").count().toPandas()  # bounded by the sample
    return train(dict(zip(rows["w"], rows["count"])))


def garbled_documents(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, chains, restored, complete) of the documents that show the result of a wrong decoding, wholly or in part.

    restored has the original text of every word that could be undone, complete is true if none was left.
    chains lists the encodings gone through. Null, empty and ASCII texts are never found. Repeated rows
    come out as often as they stand in the input; columns other than doc_id and text are ignored.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(trained_on(documents, sample))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, str | None]] = {}
        for batch in batches:
            wanted = {w for t in batch["text"] for w in _words(t)}
            new = [w for w in wanted if w not in known]
            if len(known) > 500_000:
                known, new = {}, list(wanted)
            known.update(zip(new, model.value.judge(new)))
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                hits = {w for w in _words(text) if known[w][0]}
                if hits:
                    fixed = "".join(known[p][1] if p in hits and known[p][1] is not None else p for p in re.split(r"([ \t\r\n]+)", text))
                    chains = sorted({"lost" if known[w][0] < 0 else " > ".join(f"{a} as {b}" for a, b in CHAINS[known[w][0] - 1]) for w in hits})
                    out.append((doc_id, chains, fixed, all(known[w][0] > 0 for w in hits)))
            yield pd.DataFrame(out, columns=["doc_id", "chains", "restored", "complete"])

    some = documents.where("doc_id is not null and text is not null").where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text")
    return some.mapInPandas(find, "doc_id long, chains array<string>, restored string, complete boolean")
