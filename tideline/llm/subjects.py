"""Subject areas of documents from weak labels and a latent model of their accuracy."""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.session import settle, spread

NONE, ABSTAIN, FOLLOWS = -1, -2, -3
#: Labelling functions, in the order of their columns.
FUNCTIONS = ("lexicon", "frame", "context", "section", "address", "source")
_HEAD = re.compile(r"<[hH][1-6]\b[^<>]*>")
_TAG = re.compile(r"<[^<>]*>")
#: A heading: marked as one, or a word and a number before a colon, as chapters have.
_HEADING = re.compile(r"^(?:¶ |[^\W\d_]+ # ?[:：])")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
_DATA = re.compile(r"\{[^{}]*\}|#\w+")
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=。)\s*|\n+")
_STOP = re.compile("([。！？])")
_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|#")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CLOSED = re.compile(r"[.!?…。:;][\"'”’)\]]*$")
#: Words from which a piece may be several sentences without marks.
_LONG = 24
#: Characters of texts in one stored batch of sentences, but for a longer text of its own.
_STORED = 4_000_000


def _plain(text: str) -> str:
    """Text without markup, entities, invisible characters and data fragments, in compatibility form."""
    if "<" in text:
        text = _TAG.sub("\n", _HEAD.sub("\n¶ ", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _STOP.sub(r"\1 ", text)
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return text


def words_of(sentence: str) -> list[str]:
    """Lower-case words; runs of Chinese or Japanese characters give their pairs of neighbours."""
    out: list[str] = []
    for word in _WORD.findall(sentence.lower()):
        if _CJK.search(word):
            out += [word[i : i + 2] for i in range(len(word) - 1)] or [word]
        elif len(word) > 2:
            out.append(word)
    return out


def sentences_of(text: str | None, openings: frozenset[str] | set[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Sentences of a text (digits as ``#``, lower case) and the words of its addresses. Null, empty and blank texts have none.

    Addresses, data fragments, and pieces of fewer than two words, count as no sentence; nor does a symbol string after sentences.
    Pieces without an end mark and long ones, as from a transcript, are cut before pairs of words that are ``openings``; where they
    make up most of a text, so are its other pieces.
    """
    if not text:
        return [], []
    text = _plain(text)
    addresses: list[str] = []
    if "://" in text or "www." in text:
        addresses = [w for a in _ADDRESS.findall(text) for w in words_of(re.sub(r"[/._?=&\-]", " ", a))]
        text = _ADDRESS.sub(" ", text)
    if "{" in text or "#" in text:
        text = _DATA.sub(" ", text)
    found: list[str] = []
    for piece in _END.split(text):
        piece = " ".join(piece.split()).replace(" & ", " and ")
        letters = sum(map(str.isalpha, piece))
        if letters < 4 or (" " not in piece and not _CJK.search(piece)):
            continue
        if found and not _CLOSED.search(piece) and _symbols(piece):
            continue
        found.append(_NUMBER.sub("#", piece.lower()))
    if openings and found:
        sizes = [piece.count(" ") + 1 for piece in found]
        loose = [n >= _LONG or not _CLOSED.search(piece) for piece, n in zip(found, sizes, strict=True)]
        if any(loose):
            most = 2 * sum(n for n, x in zip(sizes, loose, strict=True) if x) > sum(sizes)
            found = [part for piece, x in zip(found, loose, strict=True) for part in (_cut(piece, openings) if x or most else [piece])]
    return found, addresses


def _symbols(piece: str) -> bool:
    """Whether a piece is no language: one or two letters again and again, or a few words in three scripts or more."""
    letters = {c for c in piece.lower() if c.isalpha()}
    if len(letters) <= 2:
        return True
    if piece.isascii() or piece.count(" ") > 4:
        return False
    return len({"CJK" if _CJK.match(c) else unicodedata.name(c, "").split(" ")[0] for c in letters}) > 2


def _cut(text: str, openings: frozenset[str] | set[str], least: int = 3) -> list[str]:
    words = text.split(" ")
    starts = [0]
    for i in range(least, len(words) - 1):
        if i - starts[-1] >= least and len(words) - i >= least and f"{words[i]} {words[i + 1]}" in openings:
            starts.append(i)
    return [" ".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]


def tokens_of(sentence: str) -> list[str]:
    """Words and numbers of a sentence without its punctuation, which is what a frame is known by."""
    return _TOKEN.findall(sentence)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


class _Reader:
    """Splits documents into numbered sentences and words; remembers sentences it has met."""

    def __init__(self, openings: set[str] | None = None) -> None:
        self.known: dict[str, tuple[int, list[str], bool]] = {}
        self.openings = openings or set()
        self.texts: dict[int, str] = {}

    def read(self, texts: list[str | None]) -> _Batch:
        if len(self.known) > 200_000:
            self.known.clear()
        self.texts = {}
        vocabulary: dict[str, int] = {}
        b = _Batch()
        for d, text in enumerate(texts):
            found, addresses = sentences_of(text, self.openings)
            b.addresses.append(addresses)
            for sentence in found:
                known = self.known.get(sentence)
                if known is None:
                    known = self.known[sentence] = (_hash(" ".join(tokens_of(sentence))), list(dict.fromkeys(words_of(sentence))), bool(_HEADING.match(sentence)))
                self.texts.setdefault(known[0], sentence)
                b.doc.append(d)
                b.frame.append(known[0])
                b.heading.append(known[2])
                b.words += [vocabulary.setdefault(w, len(vocabulary)) for w in known[1]]
                b.length.append(len(known[1]))
        b.vocabulary = list(vocabulary)
        b.finish(len(texts))
        return b


@dataclass
class _Batch:
    doc: list | np.ndarray = field(default_factory=list)
    frame: list | np.ndarray = field(default_factory=list)
    words: list | np.ndarray = field(default_factory=list)
    length: list | np.ndarray = field(default_factory=list)
    heading: list | np.ndarray = field(default_factory=list)
    keys: list = field(default_factory=list)
    sources: list = field(default_factory=list)
    addresses: list = field(default_factory=list)
    vocabulary: list = field(default_factory=list)

    def finish(self, docs: int) -> None:
        self.docs = docs
        self.doc = np.array(self.doc, dtype=np.int64)
        self.frame = np.array(self.frame, dtype=np.int64)
        self.words = np.array(self.words, dtype=np.int64)
        self.length = np.array(self.length, dtype=np.int64)
        self.heading = np.array(self.heading, dtype=bool)
        self.sentence = np.repeat(np.arange(len(self.doc)), self.length)
        self.per_doc = np.bincount(self.doc, minlength=docs) if len(self.doc) else np.zeros(docs, dtype=np.int64)
        self.first = np.ones(len(self.doc), dtype=bool)
        if len(self.doc) > 1:
            self.first[1:] = self.doc[1:] != self.doc[:-1]


def _parse(openings: set[str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a key, a text and a source as compressed batches of numbered sentences and words."""
        import zstandard

        reader, press = _Reader(openings), zstandard.ZstdCompressor(3)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = np.cumsum([0 if t is None else len(t) for t in texts]) // _STORED
            for part in np.unique(at):
                rows = np.flatnonzero(at == part)
                b = reader.read([texts[i] for i in rows])
                b.keys, b.sources = batch.column(0).take(pa.array(rows)).to_pylist(), batch.column(2).take(pa.array(rows)).to_pylist()
                raw = pickle.dumps((b.keys, b.sources, b.addresses, b.vocabulary, b.doc.astype(np.int32), b.frame, b.words.astype(np.int32), b.length.astype(np.int32), b.heading))
                yield pa.RecordBatch.from_arrays([pa.array([press.compress(raw)], pa.binary())], names=["raw"])

    return kernel


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for raw in batch.column(0):
            b = _Batch()
            b.keys, b.sources, b.addresses, b.vocabulary, b.doc, b.frame, b.words, b.length, b.heading = pickle.loads(press.decompress(raw.as_py()))
            b.finish(len(b.keys))
            yield b


def _gather(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(keys, weights=values[:, c], minlength=size) for c in range(values.shape[1])], axis=1)


def _vote(sums: np.ndarray, least: float, margin: float) -> np.ndarray:
    """Best subject of each row of weights; :data:`NONE` without enough weight, :data:`ABSTAIN` where two are close."""
    if not len(sums):
        return np.zeros(0, dtype=np.int64)
    best = sums.argmax(axis=1)
    top = sums[np.arange(len(sums)), best]
    second = np.partition(sums, -2, axis=1)[:, -2]
    return np.where(top < least, NONE, np.where(top - second < margin, ABSTAIN, best))


@dataclass
class Knowledge:
    """What the labelling functions know: weights of words, votes of frames, accuracies."""

    subjects: list[str]
    lexicon: dict[str, np.ndarray]
    seeds: dict[str, np.ndarray] = field(default_factory=dict)
    frames: dict[int, int] = field(default_factory=dict)
    follows: set[int] = field(default_factory=set)
    recurrent: set[int] = field(default_factory=set)
    openings: set[str] = field(default_factory=set)
    sources: dict[str, int] = field(default_factory=dict)
    accuracies: list[tuple[str, int, float]] = field(default_factory=list)
    log_vote: np.ndarray | None = None
    log_prior: np.ndarray | None = None
    least: float = 1.2
    margin: float = 0.5

    def weights(self, batch: _Batch) -> np.ndarray:
        zero = np.zeros(len(self.subjects))
        return np.array([self.lexicon.get(w, zero) for w in batch.vocabulary]).reshape(-1, len(self.subjects))

    def lexicon_votes(self, batch: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.weights(batch)
        sums = _gather(batch.sentence, own[batch.words], len(batch.doc)) if len(batch.words) else np.zeros((len(batch.doc), len(self.subjects)))
        return _vote(sums, self.least, self.margin), sums, own

    def frame_votes(self, batch: _Batch) -> np.ndarray:
        return np.array([self.frames.get(f, ABSTAIN) for f in batch.frame.tolist()], dtype=np.int64)

    def votes(self, batch: _Batch) -> np.ndarray:
        """``[sentences, functions]``. The context is the rest of the document, where words of several subjects leave a sentence
        undecided; the section is the last heading before a sentence, by its words."""
        lexicon, sums, _ = self.lexicon_votes(batch)
        frame = self.frame_votes(batch)
        n = len(lexicon)
        base = np.where(frame != ABSTAIN, frame, lexicon)
        context = np.full(n, ABSTAIN)
        unclear = np.flatnonzero((lexicon == ABSTAIN) & (frame == ABSTAIN))  # words that several subjects share
        if len(unclear):
            hot = np.zeros((n, len(self.subjects)))
            hot[base >= 0, base[base >= 0]] = 1
            around = _gather(batch.doc, hot, batch.docs)[batch.doc[unclear]] * (sums[unclear] >= 0.5 * self.least)
            context[unclear] = np.where(around.max(axis=1) > 0, around.argmax(axis=1), ABSTAIN)
        section = np.full(n, ABSTAIN)
        if batch.heading.any():
            last = np.maximum.accumulate(np.where(batch.heading, np.arange(n), -1))
            under = np.flatnonzero((last >= 0) & ~batch.heading)
            under = under[batch.doc[last[under]] == batch.doc[under]]
            section[under] = np.where(lexicon[last[under]] >= 0, lexicon[last[under]], ABSTAIN)
        zero = np.zeros(len(self.subjects))
        by_doc = np.full((batch.docs, 2), ABSTAIN)
        for d, words in enumerate(batch.addresses):
            if words:
                vote = int(_vote(np.sum([self.lexicon.get(w, zero) for w in set(words)], axis=0)[None], self.least, self.margin)[0])
                by_doc[d, 0] = vote if vote >= 0 else ABSTAIN
            if batch.sources[d] is not None:
                by_doc[d, 1] = self.sources.get(batch.sources[d].strip().lower(), ABSTAIN)
        return np.stack([lexicon, frame, context, section, by_doc[batch.doc, 0], by_doc[batch.doc, 1]], axis=1) if n else np.zeros((0, len(FUNCTIONS)), dtype=np.int64)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """``[sentences, subjects + 1]``, the last column for no subject."""
        log = np.tile(self.log_prior, (len(votes), 1))
        for j in range(votes.shape[1]):
            log += self.log_vote[j][:, votes[:, j]].T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True)


def seed_lexicon(examples: list[tuple[str, str]], subjects: list[str], least_count: int = 2, purity: float = 0.5) -> dict[str, np.ndarray]:
    """Word weights from labelled passages: the logarithm of how much more of a word's sentences are a subject's than by chance."""
    counts: dict[str, np.ndarray] = {}
    totals = np.zeros(len(subjects))
    for subject, text in examples:
        c = subjects.index(subject)
        for sentence in sentences_of(text)[0]:
            totals[c] += 1
            for word in set(words_of(sentence)):
                counts.setdefault(word, np.zeros(len(subjects)))[c] += 1
    base = totals / max(1.0, totals.sum())
    out = {}
    for word, n in counts.items():
        share = (n + 0.5 * base) / (n.sum() + 0.5)
        weight = np.where(share >= purity, np.log(np.maximum(share, 1e-9) / np.maximum(base, 1e-9)), 0.0)
        if n.sum() >= least_count and weight.any():
            out[word] = weight
    return out


def _associate(shared, openings: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per word and frame: its sentences, and how the rest of the sentence and of the document votes; summed per batch."""
        know: Knowledge = shared.value
        k, reader = len(know.subjects), _Reader()
        for b in (reader.read(batch.column(1).to_pylist()) for batch in batches) if openings else _stored(batches):
            if not len(b.doc):
                continue
            lexicon, sums, own = know.lexicon_votes(b)
            frame = know.frame_votes(b)
            label = np.where(frame != ABSTAIN, frame, lexicon)
            hot = np.zeros((len(label), k))
            hot[label >= 0, label[label >= 0]] = 1
            doc = _gather(b.doc, hot, b.docs)
            others = (doc[b.doc] - hot) / np.maximum(1, b.per_doc[b.doc] - 1)[:, None]
            keys, kinds, numbers = [], [], []
            usable = np.array([f not in know.recurrent for f in b.frame.tolist()], dtype=bool)[b.sentence] if len(b.sentence) else np.zeros(0, dtype=bool)
            s, w = b.sentence[usable], b.words[usable]
            without = _vote(sums[s] - own[w], know.least, know.margin)
            same = np.zeros((len(s), k))
            same[without >= 0, without[without >= 0]] = 1
            n = np.bincount(w, minlength=len(b.vocabulary))
            numbers.append(np.concatenate((n[:, None], _gather(w, others[s], len(n)), np.zeros((len(n), 1)), _gather(w, same, len(n))), axis=1))
            keys += [_hash(x) for x in b.vocabulary]
            names = list(b.vocabulary)
            kinds += [0] * len(n)
            unique, where = np.unique(b.frame, return_inverse=True)
            after = np.zeros(len(label))
            after[1:] = (label[:-1] >= 0) & ~b.first[1:]
            n = np.bincount(where, minlength=len(unique))
            numbers.append(np.concatenate((n[:, None], _gather(where, others, len(unique)), np.bincount(where, weights=after, minlength=len(unique))[:, None], np.zeros((len(n), k))), axis=1))
            keys += unique.tolist()
            kinds += [1] * len(unique)
            names += [None] * len(unique)
            if openings:  # pairs of words that begin sentences, and how often they stand anywhere
                begins, anywhere = {}, {}
                for f, times in zip(unique.tolist(), n.tolist(), strict=True):
                    words = tokens_of(reader.texts[f])
                    for i, pair in enumerate(map(" ".join, zip(words, words[1:], strict=False))):
                        anywhere[pair] = anywhere.get(pair, 0) + times
                        if i == 0:
                            begins[pair] = begins.get(pair, 0) + times
                rows = np.zeros((len(begins), 2 * k + 2))
                rows[:, 0], rows[:, 1] = list(begins.values()), [anywhere[p] for p in begins]
                numbers.append(rows)
                keys += [_hash(p) for p in begins]
                kinds += [3] * len(begins)
                names += list(begins)
            # one row for the whole batch: the base rates
            totals = np.concatenate(([len(s)], others[s].sum(axis=0), [0.0], same.sum(axis=0)))
            overall = np.concatenate(([len(label)], others.sum(axis=0), [after.sum()], np.zeros(k)))
            numbers += [totals[None], overall[None]]
            keys, kinds, names = [*keys, 0, 1], [*kinds, 2, 2], [*names, "w", "f"]
            table = np.concatenate(numbers)
            seen = table[:, 0] > 0
            columns = [pa.array(np.array(kinds)[seen], pa.int32()), pa.array(np.array(keys, dtype=np.int64)[seen]), pa.array([x for x, keep in zip(names, seen, strict=True) if keep], pa.string())]
            columns += [pa.array(table[seen, i]) for i in range(2 * k + 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "name", *(f"x{i}" for i in range(2 * k + 2))])

    return kernel


def _judge(shared, purity: float, lift: float, words: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the sums of words and frames tell: ``kind`` 0 a word with its weights (none: a seed that lost them), 1 a recurring frame with its
        vote, 3 an opening."""
        base, seeds, k = shared.value
        around_base = base["w"][1 : k + 1] / max(1.0, base["w"][0]) + 1e-6
        word_base = (base["w"][1 : k + 1] + base["w"][k + 2 :]) / max(1.0, base["w"][0]) + 1e-6
        frame_base = base["f"][1 : k + 1] / max(1.0, base["f"][0]) + 1e-6
        usual_follow = base["f"][k + 1] / max(1.0, base["f"][0])
        for batch in batches:
            out = []
            table = np.stack([batch.column(3 + i).to_numpy() for i in range(2 * k + 2)], axis=1) if batch.num_rows else np.zeros((0, 2 * k + 2))
            for kind, key, name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), table, strict=True):
                n, seen = row[0], row[1 : k + 1]
                if kind == 3:
                    if not words and row[0] >= 0.7 * row[1]:
                        out.append((3, key, name, None, None))
                elif kind == 0:
                    around = (seen + around_base) / (n + 1) / around_base
                    share = (seen + row[k + 2 :] + 2 * word_base) / (n + 2)
                    pure = share / word_base / (share / word_base).sum()
                    best = int(pure.argmax())
                    ratio = share[best] / word_base[best]
                    shared_by = k > 2 and np.sort(pure)[-2:].sum() >= 1.4 * purity  # mostly with two subjects
                    sure = seen[best] - n * around_base[best] >= 2.5 * math.sqrt(n * around_base[best])  # beyond chance in the documents around
                    if ratio >= lift and (pure[best] >= purity or shared_by) and around[best] >= 2 and sure:
                        out.append((0, key, name, None, np.where(pure >= 0.25, np.log(np.maximum(share / word_base, 1e-9)), 0.0).clip(0.0, 3.0).tolist()))
                    elif name in seeds:
                        out.append((0, key, name, None, None))
                else:
                    share = (seen + frame_base) / (n + 1)
                    relative = share / frame_base
                    pure = relative / relative.sum()
                    best, vote = int(pure.argmax()), ABSTAIN
                    if relative[best] >= lift and pure[best] >= purity:
                        vote = best
                    elif pure[best] < 0.5 * purity + 0.1:
                        vote = FOLLOWS if row[k + 1] / n > 0.9 and row[k + 1] / n > 1.3 * usual_follow else NONE
                    out.append((1, key, None, vote, None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "key", "name", "vote", "weights"])

    return kernel


def _learn(rows: DataFrame, know: Knowledge, purity: float, lift: float, words: bool) -> Knowledge:
    """One round: words and frames that go with a subject more than by chance, and frames that go with none. The tasks judge; the driver gets
    what they accept. Rows are texts in the first round, which learns openings, and stored sentences in those that learn words."""
    k, spark = len(know.subjects), rows.sparkSession
    known = spark.sparkContext.broadcast(know)
    schema = "kind int, key long, name string, " + ", ".join(f"x{i} double" for i in range(2 * k + 2))
    partial = rows.mapInArrow(_associate(known, openings=not words), schema)
    least_word, least_frame = 3, 8
    sums = partial.groupBy("kind", "key").agg(F.first("name", ignorenulls=True).alias("name"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(2 * k + 2)))
    sums = settle(sums.filter((F.col("kind") == 2) | ((F.col("kind") == 0) & (F.col("x0") >= least_word)) | (F.col("kind").isin(1, 3) & (F.col("x0") >= least_frame))))
    base = {r["name"]: np.array([r[f"x{i}"] for i in range(2 * k + 2)]) for r in sums.filter("kind = 2").collect()}
    lexicon, frames, follows, recurrent, openings = dict(know.seeds), {}, set(), set(), set(know.openings)
    shared = spark.sparkContext.broadcast(({name: base.get(name, np.zeros(2 * k + 2)) for name in "wf"}, set(know.seeds), k))
    for r in sums.filter("kind <> 2").mapInArrow(_judge(shared, purity, lift, words), "kind int, key long, name string, vote int, weights array<double>").collect():
        if r["kind"] == 0:
            if r["weights"] is None:
                lexicon.pop(r["name"], None)  # seeds that the corpus says too little about stay
            else:
                lexicon[r["name"]] = np.array(r["weights"])
        elif r["kind"] == 3:
            openings.add(r["name"])
        else:
            recurrent.add(r["key"])
            if r["vote"] == FOLLOWS:
                follows.add(r["key"])
            elif r["vote"] != ABSTAIN:
                frames[r["key"]] = r["vote"]
    return Knowledge(know.subjects, lexicon if words else know.lexicon, know.seeds, frames, follows, recurrent, openings, know.sources, least=know.least, margin=know.margin)


def _patterns(shared):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Knowledge = shared.value
        width = len(know.subjects) + 2
        for b in _stored(batches):
            votes = know.votes(b)
            codes = (votes + 2) @ (width ** np.arange(votes.shape[1]))
            unique, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n)], names=["code", "n"])

    return kernel


def fit_accuracies(votes: np.ndarray, counts: np.ndarray, subjects: int, rounds: int = 60, belief: float = 0.5) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Latent model of the votes: ``log P(vote | class)`` per function, the classes' log prior and the share of each function's votes for
    sentences with a subject that are right, by expectation maximisation.

    Given the class, functions vote independently; abstaining depends on the function only and so tells nothing. A function that
    votes has, for subjects together, the probabilities of the right subject, a wrong one and none, and, for sentences without
    subject, of any subject and none. ``votes`` are distinct patterns with their ``counts``. Start: right with
    probability 0.9, frames, whose votes are statistics of many occurrences, with 0.98; this
    belief weighs ``belief`` times the function's own votes, so that it fades for none by being rare and for none by the corpus being small.
    """
    functions = votes.shape[1]
    theta = np.tile(np.array([0.9, 0.05, 0.05]), (functions, 1))
    empty = np.tile(np.array([0.1, 0.9]), (functions, 1))
    theta[1], empty[1] = [0.98, 0.01, 0.01], [0.02, 0.98]
    prior = np.append(np.full(subjects, 0.5 / subjects), 0.5)
    # most sentences have one vote, which alone can't tell a rare class from a bad function
    own = [belief * float(counts[votes[:, j] != ABSTAIN].sum()) + 1.0 for j in range(functions)]
    believed = ([n * t for n, t in zip(own, theta, strict=True)], [n * e for n, e in zip(own, empty, strict=True)])

    def tables() -> np.ndarray:
        # votes index from the end: -1 is none, -2 abstains
        out = np.ones((functions, subjects + 1, subjects + 2))
        for j in range(functions):
            out[j, :subjects, :subjects] = theta[j, 1] / max(1, subjects - 1)
            out[j, np.arange(subjects), np.arange(subjects)] = theta[j, 0]
            out[j, :subjects, NONE] = theta[j, 2]
            out[j, subjects, :subjects] = empty[j, 0] / subjects
            out[j, subjects, NONE] = empty[j, 1]
        return np.log(np.maximum(out, 1e-12))

    log_vote = tables()
    for _ in range(rounds if len(votes) else 0):
        log = np.tile(np.log(prior), (len(votes), 1))
        for j in range(functions):
            log += log_vote[j][:, votes[:, j]].T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        p = p / p.sum(axis=1, keepdims=True) * counts[:, None]
        prior = (p.sum(axis=0) + 1.0) / (p.sum() + subjects + 1.0)
        about = p[:, :subjects]
        for j in range(functions):
            v = votes[:, j]
            right = about[np.arange(len(v)), np.maximum(v, 0)][v >= 0].sum()
            wrong = about[v >= 0].sum() - right
            theta[j] = np.array([right, wrong, about[v == NONE].sum()]) + believed[0][j]
            theta[j] /= theta[j].sum()
            empty[j] = np.array([p[v >= 0, subjects].sum(), p[v == NONE, subjects].sum()]) + believed[1][j]
            empty[j] /= empty[j].sum()
        log_vote = tables()
    return log_vote, np.log(prior), [float(t[0]) for t in theta]


def fit_subjects(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", rounds: int = 3, purity: float = 0.5, lift: float = 2.0) -> tuple[Knowledge, DataFrame]:
    """Fit the labelling functions and their accuracies on all documents. Result: what they know, and the sentences of all documents,
    stored as compressed batches (see :func:`assign_subjects`). Texts are read twice: for the openings of sentences, then for the sentences;
    ``rounds + 1`` jobs go over the stored sentences.

    ``examples`` (``subject, text``; names trimmed and in lower case; nulls are left out) give the first lexicon: a fixed table, read by the
    driver. Each round labels all sentences and keeps the words and frames (whole sentences, digits aside) that stand with one
    subject ``lift`` times as often as usual and mostly with it (words are judged by the rest of their sentences and documents, frames, which recur,
    by the rest of their documents alone, and words aren't judged by recurring sentences), at least 3 and 8 times whatever the size
    of the corpus. Counts are summed and judged in tasks; the driver holds the accepted words and the recurring frames, which grow as the
    corpus' vocabulary does. Frames that stand with all subjects alike vote for none.
    """
    spark = documents.sparkSession
    labelled = [(r.s, r.t) for r in examples.select(F.lower(F.btrim("subject", F.lit(" \t\r\n"))).alias("s"), F.col("text").alias("t")).dropna().collect()]
    subjects = sorted({s for s, _ in labelled})
    seeds = seed_lexicon(labelled, subjects)
    chance = math.log(max(2, len(subjects)))  # a word that only one of the subjects uses weighs about this
    know = Knowledge(subjects, seeds, seeds, least=0.5 * chance, margin=0.2 * chance)
    rows = spread(documents.select(key, text, source), key)
    total = documents.count()
    if subjects:
        know = _learn(rows, know, purity, lift, words=False)
    parsed = settle(rows.mapInArrow(_parse(know.openings), "raw binary"))
    if not subjects:
        return know, parsed
    for _ in range(rounds - 1):
        know = _learn(parsed, know, purity, lift, words=True)
    shared = spark.sparkContext.broadcast(know)
    sources = parsed.mapInArrow(_source_votes(shared), "source string, vote int, n long").groupBy("source", "vote").agg(F.sum("n").alias("n")).filter(F.col("vote") >= 0)
    by_source: dict[str, int] = {}
    for r in sources.groupBy("source").agg(F.max_by("vote", "n").alias("vote"), F.max("n").alias("most"), F.sum("n").alias("n")).filter((F.col("most") >= 0.5 * F.col("n")) & (F.col("n") >= max(20, 1e-4 * total))).collect():
        by_source[r.source] = r.vote
    know.sources = by_source
    shared = spark.sparkContext.broadcast(know)
    patterns = parsed.mapInArrow(_patterns(shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    width = len(subjects) + 2
    votes = (np.array([r["code"] for r in patterns], dtype=np.int64)[:, None] // width ** np.arange(len(FUNCTIONS)) % width) - 2
    counts = np.array([r["n"] for r in patterns], dtype=np.float64)
    know.log_vote, know.log_prior, right = fit_accuracies(votes, counts, len(subjects))
    know.accuracies = [(name, int(counts[votes[:, j] != ABSTAIN].sum()), right[j]) for j, name in enumerate(FUNCTIONS)]
    return know, parsed


def _source_votes(shared):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Knowledge = shared.value
        for b in _stored(batches):
            names = [None if x is None else x.strip().lower() for x in b.sources]
            votes, _, _ = know.lexicon_votes(b)
            counts: dict[tuple, int] = {}
            for d, v in zip(b.doc.tolist(), votes.tolist(), strict=True):
                if names[d] is not None:
                    counts[names[d], v] = counts.get((names[d], v), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in counts], pa.string()), pa.array([v for _, v in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["source", "vote", "n"])

    return kernel


def _assign(shared, share: float, key_type: pa.DataType):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Knowledge = shared.value
        k, names = len(know.subjects), np.array(know.subjects, dtype=object)
        for b in _stored(batches):
            p = know.posterior(know.votes(b)) if len(b.doc) else np.zeros((0, k + 1))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=np.int64)
            counted = np.array([f not in know.follows for f in b.frame.tolist()], dtype=bool) | b.first if len(p) else np.zeros(0, dtype=bool)
            sentences = np.bincount(b.doc[counted], minlength=b.docs)
            about = np.zeros((b.docs, k))
            expected = _gather(b.doc[counted], p[counted, :k], b.docs) if counted.any() else about
            np.add.at(about, (b.doc[counted & (best < k)], best[counted & (best < k)]), 1)
            d, c = np.nonzero((about > 0) & (about >= share * sentences[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array([b.keys[i] for i in d], key_type), pa.array(names[c] if len(c) else [], pa.string()), pa.array(about[d, c].astype(np.int64)), pa.array(sentences[d].astype(np.int64)), pa.array(expected[d, c] / np.maximum(1, sentences[d]))], names=["key", "subject", "about", "sentences", "expected_share"])

    return kernel


def assign_subjects(documents: DataFrame, know: Knowledge, parsed: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 0.25) -> DataFrame:
    """``<key>, subject, about, sentences, expected_share``: subjects that at least ``share`` of a document's sentences are about.

    A sentence is about the class with the greatest posterior probability, if that is a subject. A document may have none, one or several;
    null, empty and blank texts have none. One pass without shuffle over ``parsed``, the stored sentences of these documents from
    :func:`fit_subjects`, or over the texts; repeated documents come out each time.
    """
    kind = documents.schema[key].dataType
    schema = f"key {kind.simpleString()}, subject string, about long, sentences long, expected_share double"
    if not know.subjects:
        return documents.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if parsed is None:
        parsed = spread(documents.select(key, text, source), key).mapInArrow(_parse(know.openings), "raw binary")
    shared = documents.sparkSession.sparkContext.broadcast(know)
    return parsed.mapInArrow(_assign(shared, share, to_arrow_type(kind)), schema).withColumnRenamed("key", key)
