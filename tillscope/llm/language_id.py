"""Language of whole texts: unigram piece models that sum over all segmentations.

Every language has its own probabilities for the pieces of one fixed public
vocabulary.  The likelihood of a word is the sum over all ways to cut it into
pieces, by a forward pass over its letters; the probabilities come from
expectation maximisation with forward and backward passes over the words of a
bounded sample of labelled documents (``DOCUMENTS`` per language expected, drawn by
a hash of the id; all their words of at most ``LEARNED`` letters).  A letter that no
piece covers costs a fixed small probability, so every word has a likelihood.

Words are cut at ASCII white space, lower-cased and freed of punctuation at the
ends.  A word of any length is summed over all its segmentations: sums are scaled
every ``STEP`` letters, and letters are read ``STRETCH`` at a time with the sums that
later pieces may start from carried along, so memory does not grow with the word.  A
null text, and one without a letter, is ``und`` with score 0; so is every text if no
labelled row can be learned from.  Rows with a null label or id are not learned from
but get an answer.  Equal likelihoods go to the first language by name.  Repeated rows
get the same answer, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.labelled import drawn_by_hash, held_out, remainder
from tillscope.llm.texts import bare, map_batches, split_words, sums, text_slices

DOCUMENTS = 400
ROUNDS = 4
LEARNED = 200
UNKNOWN = 1e-7
# Between two scalings a sum falls by at most UNKNOWN per letter of STEP and of the longest piece.
STEP = 16
# A multiple of STEP.
STRETCH = 4096
CELLS = 1 << 14
START = "▁"
REMEMBERED = 1 << 18
UNDETERMINED = "und"


def read_pieces(path: str) -> list[str]:
    """Lower-case pieces of a public SentencePiece vocabulary."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not processor.is_byte(i))
    return sorted({p for p in pieces if p == p.lower() and not p.startswith("<")})


class Segmenter:
    """All pieces found in a list of words, ordered so that passes over the letters are array operations."""

    def __init__(self, pieces: list[str]):
        self.size = np.array([len(p) for p in pieces] + [1])
        self.widest = int(self.size.max())
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece, i)
        if pieces:
            self.automaton.make_automaton()
        self.unknown = len(pieces)

    def matches(self, texts: list[str], skip: int):
        """Arrays word, end and piece of all matches that end after the first ``skip`` letters; any letter may be unknown."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length + 1) - (length + 1)
        found = list(self.automaton.iter("\n".join(texts))) if self.unknown else []
        last = np.fromiter((e for e, _ in found), np.int64, len(found))
        piece = np.fromiter((p for _, p in found), np.int64, len(found))
        word = np.searchsorted(first, last, side="right") - 1
        single = np.repeat(np.arange(len(texts)), length)
        place = np.arange(len(single)) - np.repeat(np.cumsum(length) - length, length)
        word = np.concatenate([word, single])
        end = np.concatenate([last - first[word[: len(last)]], place]) + 1
        piece = np.concatenate([piece, np.full(len(single), self.unknown)])
        late = end > skip
        return word[late], end[late], piece[late]

    def advance(self, sums: np.ndarray, scale: np.ndarray, matches, base: int, logs: np.ndarray | None = None) -> None:
        """Fill sums (word, place, language) behind place ``base``, scaled by exp(scale); words come longest first.

        A match is (word, start, end, piece probabilities by language); every word has one at each place
        up to its end, so those that end at a place are the first words, without gaps.
        """
        word, start, end, factor = matches
        count = len(sums)
        key = end * count + word
        order = np.argsort(key, kind="stable")
        word, start, factor, key = word[order], start[order], factor[order], key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        places = key[heads] // count
        last = int(places[-1]) if len(places) else base
        bounds = np.searchsorted(places, np.arange(base + 1, last + 2))
        for place, a, b in zip(range(base + 1, last + 1), bounds[:-1], bounds[1:], strict=True):
            low, high = heads[a], heads[b] if b < len(heads) else len(key)
            part = sums[word[low:high], start[low:high]] * factor[low:high]
            reached = b - a
            sums[:reached, place] = np.add.reduceat(part, heads[a:b] - low, axis=0)
            if logs is not None:
                logs[:reached, place] = np.log(sums[:reached, place]) + scale[:reached]
            if (place - base) % STEP == 0:
                window = sums[:reached, max(0, place - self.widest + 1) : place + 1]
                top = window.max(axis=1)
                window /= top[:, None]
                scale[:reached] += np.log(top)

    def likelihood(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word (rows) in each language (columns)."""
        answer = np.zeros((len(words), table.shape[1]))
        for batch in _by_length(words):
            marked = [START + words[i] for i in batch]
            length = np.array([len(w) for w in marked])
            scale = np.zeros((len(batch), table.shape[1]))
            # Place 0 of the sums is ``widest`` letters before the stretch, place ``widest`` its border.
            sums = np.zeros((len(batch), self.widest + 1 + min(int(length[0]), STRETCH), table.shape[1]))
            sums[:, self.widest] = 1
            for low in range(0, int(length[0]), STRETCH):
                active = int(np.searchsorted(-length, -low))
                before = min(low, self.widest)
                word, end, piece = self.matches([w[low - before : low + STRETCH] for w in marked[:active]], before)
                end += self.widest - before
                matches = word, end - self.size[piece], end, table[piece]
                self.advance(sums[:active], scale[:active], matches, self.widest)
                done = np.flatnonzero(length[:active] <= low + STRETCH)
                final = sums[done, self.widest + length[done] - low]
                answer[batch[done]] = np.log(final) + scale[done]
                if low + STRETCH < length[0]:
                    sums[:, : self.widest + 1] = sums[:, STRETCH:]
        return answer

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (rows) in each language (columns), by sums from both ends of each word."""
        total = np.zeros_like(table)
        for batch in _by_length(words):
            marked = [START + words[i] for i in batch]
            length = np.array([len(w) for w in marked])
            word, end, piece = self.matches(marked, 0)
            start, factor = end - self.size[piece], table[piece]
            far = length[word]
            ahead, behind = (
                self._all_sums(len(batch), int(length[0]), (word, a, b, factor))
                for a, b in ((start, end), (far - end, far - start))
            )
            whole = ahead[np.arange(len(batch)), length]
            use = np.exp(ahead[word, start] + np.log(factor) + behind[word, far - end] - whole[word])
            use *= counts[batch][word]
            for column in range(table.shape[1]):
                total[:, column] += np.bincount(piece, use[:, column], len(table))
        return total

    def _all_sums(self, count: int, top: int, matches) -> np.ndarray:
        """Logarithms of the sums at every place."""
        languages = matches[3].shape[1]
        sums, logs = np.zeros((2, count, top + 1, languages))
        sums[:, 0] = 1
        self.advance(sums, np.zeros((count, languages)), matches, 0, logs)
        return logs


def _by_length(words: list[str]):
    """Positions of words, longest first, in batches of at most CELLS letters when padded, or of one word."""
    length = np.fromiter(map(len, words), np.int64, len(words)) + len(START)
    order = np.argsort(-length, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, CELLS // int(min(length[order[at]], STRETCH)))
        yield order[at : at + size]
        at += size


def learn(pieces: list[str], counted: dict[str, dict[str, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages by name and a probability per piece and language, from counted words."""
    languages = sorted(counted)
    index: dict[str, int] = {}
    rows: list[tuple[int, int, int]] = []
    for column, language in enumerate(languages):
        for word, n in counted[language].items():
            rows.append((index.setdefault(word, len(index)), column, n))
    counts = np.zeros((len(index), len(languages)))
    for row, column, n in rows:
        counts[row, column] += n
    segmenter = Segmenter(pieces)
    table = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    table[-1] = UNKNOWN
    for _ in range(rounds):
        uses = segmenter.expected(list(index), counts, table)[:-1]
        together = uses.sum(axis=1, keepdims=True)
        own = uses / np.maximum(uses.sum(axis=0), 1e-9)
        table[:-1] = 0.95 * own + 0.05 * together / max(together.sum(), 1e-9) + 1e-9
    return languages, table


def _plain(word: str) -> str:
    word = bare(word)
    return word if any(map(str.isalpha, word)) else ""


def count_words(documents: DataFrame) -> DataFrame:
    """(lang, word, n) over the rows given; one row per word and slice, to be added up."""

    def count(batches):
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"))
            names = batch.column("lang").to_pylist()
            languages = {name: i for i, name in enumerate(dict.fromkeys(names))}
            of_row = np.array([languages[n] for n in names])
            plain: dict[str, int] = {}
            code = np.fromiter((plain.setdefault(_plain(w), len(plain)) for w in words.vocabulary), np.int64)
            of_word = np.repeat(of_row, np.diff(words.starts))
            key, n = np.unique(of_word * max(1, len(plain)) + code[words.codes], return_counts=True)
            by_code, by_name = list(plain), list(languages)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([by_name[k // len(plain)] for k in key], pa.string()),
                    "word": pa.array([by_code[k % len(plain)] for k in key], pa.string()),
                    "n": pa.array(n, pa.int64()),
                }
            )

    return map_batches(documents.select("lang", "text"), count, "lang string, word string, n long")


def fit_languages(documents: DataFrame, pieces: list[str], per_language: int = DOCUMENTS):
    """Languages and piece probabilities learned from the rows that are not held out."""
    known = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 5) != 0)
    )
    # One row per language.
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((len(pieces) + 1, 0))
    pairs = [F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, per_language / n))]
    drawn = known.where(drawn_by_hash(F.create_map(*pairs)[F.col("lang")], "doc_id"))
    counted = count_words(drawn).where((F.col("word") != "") & (F.length("word") <= LEARNED))
    kept = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    by_language: dict[str, dict[str, int]] = {name: {} for name in sizes}
    for row in sorted(kept, key=lambda r: (r["lang"], r["word"])):
        by_language[row["lang"]][row["word"]] = row["n"]
    return learn(pieces, by_language)


def score_batches(batches, pieces: list[str], languages: list[str], table: np.ndarray):
    """doc_id, lang_pred and score of each row."""
    segmenter = Segmenter(pieces)
    rows: dict[str, int] = {}
    matrix = np.zeros((0, len(languages)))
    for batch in text_slices(batches, "text"):
        words = split_words(batch.column("text"))
        plain = [_plain(w) for w in words.vocabulary]
        if len(rows) > REMEMBERED:
            rows, matrix = {}, matrix[:0]
        fresh = list(dict.fromkeys(w for w in plain if w not in rows))
        scores = segmenter.likelihood(fresh, table) if languages else np.zeros((len(fresh), 0))
        rows.update({w: len(rows) + i for i, w in enumerate(fresh)})
        matrix = np.concatenate([matrix, scores])
        code = np.fromiter(map(rows.__getitem__, plain), np.int64, len(plain))
        total = sums(matrix[code[words.codes]], words.starts)
        letters = np.fromiter((any(map(str.isalpha, w)) for w in words.vocabulary), np.int64, len(words.vocabulary))
        any_letter = sums(letters[words.codes], words.starts) > 0
        names = np.full(batch.num_rows, UNDETERMINED, dtype=object)
        score = np.zeros(batch.num_rows)
        if languages:
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names[any_letter] = np.array(languages, dtype=object)[best[any_letter]]
            score[any_letter] = share[any_letter]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )


def identify_language(documents: DataFrame, vocabulary: str | None = None, per_language: int = DOCUMENTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; ``vocabulary`` is a SentencePiece model file."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    pieces = read_pieces(vocabulary)
    languages, table = fit_languages(documents, pieces, per_language)
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    scored = map_batches(
        documents.select("doc_id", "text"), lambda batches: score_batches(batches, pieces, languages, table), schema
    )
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
