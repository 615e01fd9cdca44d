"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary. A word's probability in a language is
the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. The piece probabilities are fitted by expectation maximisation (forward and backward sums) on a
bounded sample for each language.

Words are lower-cased runs between ASCII white space with ASCII punctuation and digits cut off. Each distinct
word of a slice is scored once. A word of over ``BLOCK`` characters is scored in blocks of that size, all at once,
as linear maps of the forward state at a block's begin (all pieces that cross it included) to that at its end;
only for the fit are such words cut.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without training rows all
texts are ``und``; ties go to the language that sorts first; repeated rows get equal results; an empty table
gives no rows; other columns are ignored. Every language is learned, however often its texts repeat; of more than
1,000 the most frequent are, and the others cannot be predicted. Memory does not grow with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, map_texts, table
from .sampling import held_out, per_value_sample

BLOCK = 24
#: The training sample's bound: texts of each language, and code points of one (longer texts in windows spread over them).
PER_LANGUAGE, MAX_CHARS = 400, 4000
ROUNDS = 4
SLOTS, SLOTS_LEFT = 22, 16
#: Words times languages that are scored at once.
AT_ONCE = 80_000
#: Blocks of a long word that are worked out at once.
TOGETHER = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
NOT_WORD = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTER = r"\pL"


class Pieces:
    """Finds the vocabulary piece of any run of characters: a hash table with one piece for each slot, and a
    second one, by other bits of the hash, for the pieces whose slot is taken. Characters are always
    pieces: those outside the vocabulary share one unknown piece.
    """

    def __init__(self, pieces: list[str]):
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.ids = np.full(1 << SLOTS, -1, np.int32)
        self.size, self.unknown = len(pieces) + 1, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        left: list[tuple[int, np.uint64]] = []
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            for c in p:
                h = self.extend(h, np.uint64(ord(c)))
            at = int(h >> np.uint64(64 - SLOTS))
            if self.ids[at] < 0:
                self.ids[at], self.keys[at] = i, h
            else:
                left.append((i, h))
        # the first bits by which the pieces left over all have slots of their own
        for self.shift in range(0, 64 - SLOTS):
            slots = [self._second(h) for _, h in left]
            if len(set(slots)) == len(slots):
                break
        else:
            raise ValueError("the vocabulary's pieces do not fit into two tables")
        self.more_keys, self.more_ids = np.zeros(1 << SLOTS_LEFT, np.uint64), np.full(1 << SLOTS_LEFT, -1, np.int32)
        for at, (i, h) in zip(slots, left, strict=True):
            self.more_keys[at], self.more_ids[at] = h, i

    def _second(self, h):
        return (h >> np.uint64(self.shift)).astype(np.int64) & ((1 << SLOTS_LEFT) - 1)

    @staticmethod
    def extend(h, c):
        with np.errstate(over="ignore"):
            return (h + c + np.uint64(1)) * _STEP ^ ((h + c) >> np.uint64(17))

    def of(self, chars: np.ndarray) -> np.ndarray:
        """chars: words x length. Returns ids (length of piece - 1, words, start), -1 where there is none."""
        words, length = chars.shape
        out = np.full((min(self.longest, length), words, length), -1, np.int32)
        h = np.zeros((words, length), np.uint64)
        for n in range(out.shape[0]):
            m = length - n
            h = self.extend(h[:, :m], chars[:, n:])
            at = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
            more = self._second(h)
            out[n, :, :m] = np.where(self.keys[at] == h, self.ids[at], np.where(self.more_keys[more] == h, self.more_ids[more], -1))
        out[0][out[0] < 0] = self.unknown
        return out


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece vocabulary, word marks removed."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, None] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", "").lower()
            if piece:
                found[piece] = None
    return list(found)


def by_length(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Character matrices of the words' blocks, one for each block length, with each block's word number."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    number = -(-sizes // BLOCK)
    word = np.repeat(np.arange(len(words)), number)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(number) - number, number)
    begin = starts[word] + nth * BLOCK
    size = np.minimum(BLOCK, sizes[word] - nth * BLOCK)
    return [(chars[begin[at][:, None] + np.arange(n)], word[at]) for n in np.unique(size) if len(at := np.flatnonzero(size == n))]


def forward(ids: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """alpha (positions 0 to length, words, languages): the sum over all segmentations of each prefix."""
    most, words, length = ids.shape
    alpha = np.zeros((length + 1, words, probability.shape[1]))
    alpha[0] = 1
    for end in range(1, length + 1):
        for n in range(1, min(most, end) + 1):
            piece = ids[n - 1, :, end - n]
            some = np.flatnonzero(piece >= 0)
            if len(some):
                alpha[end, some] += alpha[end - n, some] * probability[piece[some]]
    return alpha


def log_long(pieces: Pieces, word: str, probability: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of a long word, for each language, block by block.

    Within each block the forward recursion starts from every place that a piece can come from, for all
    blocks at once; the blocks are then chained, rescaled so that nothing vanishes.
    """
    far, n, languages = pieces.longest, len(word), probability.shape[1]
    number = -(-n // BLOCK)
    chars = np.zeros(far - 1 + number * BLOCK, np.uint64)
    chars[far - 1 : far - 1 + n] = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    # state: the forward sums at the far places up to a block's begin
    state, log = np.zeros((far, languages)), np.zeros(languages)
    state[-1] = 1
    for a in range(0, number, TOGETHER):
        blocks = np.arange(a, min(number, a + TOGETHER))
        ids = pieces.of(chars[blocks[:, None] * BLOCK + np.arange(far - 1 + BLOCK)])
        alpha = np.zeros((far + BLOCK, len(blocks), far, languages))
        alpha[np.arange(far), :, np.arange(far)] = 1
        for end in range(far, far + BLOCK):
            for k in range(1, len(ids) + 1):
                piece = ids[k - 1, :, end - k]
                some = np.flatnonzero(piece >= 0)
                if len(some):
                    alpha[end, some] += alpha[end - k, some] * probability[piece[some], None]
        for i, block in enumerate(blocks.tolist()):
            if block == number - 1:
                return log + np.log((alpha[n - block * BLOCK + far - 1, i] * state).sum(0))
            after = np.einsum("tpl,pl->tl", alpha[BLOCK:, i], state)
            scale = after.max(0)
            state, log = after / scale, log + np.log(scale)
    return log


def fit_pieces(pieces: Pieces, words: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """The piece probabilities of one language, by expectation maximisation over its distinct words."""
    p = np.full((pieces.size, 1), 1 / pieces.size)
    names = list(words)
    weight = np.fromiter(words.values(), np.float64, len(words))
    made = [(pieces.of(chars), weight[word]) for chars, word in by_length(names)] if names else []
    for _ in range(rounds):
        counts = np.zeros(pieces.size)
        for ids, w in made:
            most, n_words, length = ids.shape
            alpha = forward(ids, p)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[length] = 1
            share = w / alpha[length]
            for start in range(length - 1, -1, -1):
                for n in range(1, min(most, length - start) + 1):
                    piece = ids[n - 1, :, start]
                    some = np.flatnonzero(piece >= 0)
                    if len(some):
                        part = p[piece[some], 0] * beta[start + n, some]
                        beta[start, some] += part
                        counts += np.bincount(piece[some], alpha[start, some] * part * share[some], pieces.size)
        counts += 0.01
        p = (counts / counts.sum())[:, None]
    return p[:, 0]


def clean_words(texts: pa.Array) -> pa.Array:
    """The words of each text, as lists."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), NOT_WORD, " "))


class LanguageModel:
    def __init__(self, path: str, samples: dict[str, list[str]]):
        self.path, self.languages = path, sorted(samples)
        pieces = Pieces(vocabulary(path))
        columns = []
        for lang in self.languages:
            words = clean_words(pa.array(samples[lang], pa.string())).flatten().value_counts()
            columns.append(fit_pieces(pieces, {r["values"]: r["counts"] for r in words.to_pylist() if r["values"]}))
        self.probability = np.stack(columns, 1) if columns else np.zeros((pieces.size, 0))
        self.pieces: Pieces | None = None

    def log_words(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language."""
        if self.pieces is None:
            self.pieces = Pieces(vocabulary(self.path))
        out = np.zeros((len(words), len(self.languages)))
        for i, w in enumerate(words):
            if len(w) > BLOCK:
                out[i] = log_long(self.pieces, w, self.probability)
        short = [i for i, w in enumerate(words) if len(w) <= BLOCK]
        for chars, word in by_length([words[i] for i in short]) if short else ():
            word = np.array(short)[word]
            step = max(1, AT_ONCE // max(1, len(self.languages)))
            for a in range(0, len(word), step):
                alpha = forward(self.pieces.of(chars[a : a + step]), self.probability)[-1]
                np.add.at(out, word[a : a + step], np.log(np.maximum(alpha, 1e-300)))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lists = clean_words(texts)
        coded = lists.flatten().dictionary_encode()
        known = np.array([bool(w) for w in coded.dictionary.to_pylist()])
        logs = self.log_words([w if w else "" for w in coded.dictionary.to_pylist()])
        letters = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        total = np.zeros((len(ends), len(self.languages)))
        steps = logs[coded.indices.to_numpy()] if len(known) else np.zeros((0, len(self.languages)))
        running = np.concatenate([np.zeros((1, steps.shape[1])), np.cumsum(steps, axis=0)])
        total = running[ends[1:]] - running[ends[:-1]]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)

    def __getstate__(self):
        return self.__dict__ | {"pieces": None}


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = model.predict(part.column("text"))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

        return work

    return map_texts(documents_only(docs), "doc_id long, lang_pred string, score double", build, limit=max(1 << 16, (4 << 20) * 4 // max(4, len(model.languages))))


def fit(docs: DataFrame, usable, path: str | None = None) -> LanguageModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return LanguageModel(path, per_value_sample(docs.select("doc_id", "text", "lang"), "lang", usable, PER_LANGUAGE, MAX_CHARS))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(4, 2))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
