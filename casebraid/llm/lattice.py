"""Language-model scoring (operator 11): the marginal probability of a text over all its segmentations into subwords.

The subwords and their first weights are an existing vocabulary's: its scores, read as ranks of a Zipf law. Expectation
maximisation over the distinct training words fits the weights, with the first ones as prior. A word's probability is
the sum over all segmentations, by the forward recursion in log space; words begin at a mark of their own, so a text's
lattice falls into its words' lattices. A training word has a further edge from end to end, whose weight is its
discounted share of the training tokens; the discounts are the share of the subword lattice.

Word counts stay a table. Words that are frequent enough to be few (at most FREQUENT) are sent to all tasks, with their
counts; the other words of each text meet the table in a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column
from .shingles import mix

#: The bound of the words that are sent to every task, and the bytes of the longest of them.
FREQUENT = 65_536
FREQUENT_BYTES = 128
#: Rounds of expectation maximisation, and the weight of the vocabulary's own scores in words.
ROUNDS = 2
PRIOR = 1000.0
#: Characters of words whose lattices are held at once; one longer word stands alone.
LATTICE = 1 << 14
#: What begins every word in the vocabulary. In a text it is an ordinary character, which only bytes spell.
MARK = 0x2581
_ORDINARY_MARK = 0x110000
RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts with A-Z in lower case, and where each text's begin (one entry more)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    return flat, ends


def vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of a sentencepiece model, their log weights by a Zipf law of their scores' ranks, and those of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = np.array([model.get_score(i) for i in ids])
    rank = np.empty(len(ids))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(ids))
    weight = np.concatenate([1 / (rank + 2.7), np.full(256, 1 / (len(ids) + 2.7))])
    log_p = np.log(weight / weight.sum())
    return [model.id_to_piece(i) for i in ids], log_p[: len(ids)], log_p[len(ids) :]


class Lattice:
    """Subwords with log weights (natural), and the lattices of words over them."""

    def __init__(self, pieces: list[str], log_p: np.ndarray, log_bytes: np.ndarray):
        self.log_p = np.concatenate([log_p, log_bytes])
        self.n = len(pieces)
        self.longest = max([1, *map(len, pieces)])
        self.step = mix(np.arange(1, self.longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.by_length = []
        lengths = np.array([len(p) for p in pieces], np.int64)
        for size in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == size)
            codes = np.frombuffer("".join(pieces[k] for k in own.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, size)
            keys = mix((mix(codes + np.uint64(1)) * self.step[:size]).sum(axis=1, dtype=np.uint64))
            order = np.argsort(keys)
            self.by_length.append((keys[order], own[order]))

    def groups(self, words: list[str]):
        """Words in order of length, as index and a matrix of codes: each of about LATTICE characters, shorter ones padded by zeros."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            sizes = lengths[order[at : at + LATTICE // 2]]
            to = at + max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), LATTICE, side="right")))
            mine = order[at:to]
            codes = np.zeros((len(mine), int(lengths[mine[-1]])), np.uint32)
            codes[:, 0] = MARK
            flat = np.frombuffer("".join(words[k] for k in mine.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
            flat = np.where(flat == MARK, _ORDINARY_MARK, flat)
            inside = np.arange(1, codes.shape[1])[None, :] < lengths[mine][:, None]
            codes[:, 1:][inside] = flat
            yield mine, codes, lengths[mine]
            at = to

    def edges(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every end and length: the piece (-1: none) and its log weight; and of every character the log weight of its bytes."""
        rows, width = codes.shape
        most = min(self.longest, width)
        piece = np.full((rows, width, most), -1, np.int32)
        mixed = mix(codes.astype(np.uint64) + np.uint64(1))
        total = np.zeros((rows, width), np.uint64)
        for size in range(1, most + 1):
            total = total[:, : width - size + 1] + mixed[:, size - 1 :] * self.step[size - 1]
            keys, own = self.by_length[size - 1]
            if not len(keys):
                continue
            wanted = mix(total)
            at = np.minimum(np.searchsorted(keys, wanted.ravel()), len(keys) - 1).reshape(wanted.shape)
            piece[:, size - 1 :, size - 1] = np.where(keys[at] == wanted, own[at], -1)
        piece[np.arange(width)[None, :] >= lengths[:, None]] = -1
        weight = np.where(piece >= 0, self.log_p[piece], -np.inf)
        known, where = np.unique(codes, return_inverse=True)
        spelled = np.array([self.log_p[self.n + _bytes_of(c)].sum() for c in known.tolist()])
        return piece, weight, spelled[where].reshape(codes.shape)

    def _forward(self, weight: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log sums over all segmentations up to each place; places before the first are -inf."""
        rows, width, most = weight.shape
        at = np.full((rows, most + width), -np.inf)
        at[:, most - 1] = 0.0
        for end in range(width):
            ways = at[:, end : end + most][:, ::-1] + weight[:, end]
            ways[:, 0] = np.logaddexp(ways[:, 0], at[:, end + most - 1] + spelled[:, end])
            top = ways.max(axis=1, keepdims=True)
            at[:, end + most] = top[:, 0] + np.log(np.exp(ways - top).sum(axis=1))
        return at

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for mine, codes, lengths in self.groups(words):
            _, weight, spelled = self.edges(codes, lengths)
            at = self._forward(weight, spelled)
            out[mine] = at[np.arange(len(mine)), weight.shape[2] - 1 + lengths]
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece, then each byte, is used in the words, on the average over their segmentations."""
        uses = np.zeros(self.n + 256)
        for _, codes, lengths in self.groups(words):
            piece, weight, spelled = self.edges(codes, lengths)
            rows, width, most = weight.shape
            at = self._forward(weight, spelled)
            whole = at[np.arange(rows), most - 1 + lengths]
            rest = np.full((rows, width + 1 + most), -np.inf)
            rest[np.arange(rows), lengths] = 0.0
            for start in range(width - 1, -1, -1):
                steps = np.arange(min(most, width - start))
                ways = weight[:, start + steps, steps] + rest[:, start + 1 + steps]
                ways[:, 0] = np.logaddexp(ways[:, 0], spelled[:, start] + rest[:, start + 1])
                top = np.maximum(ways.max(axis=1, keepdims=True), -1e300)
                here = top[:, 0] + np.log(np.maximum(np.exp(ways - top).sum(axis=1), 1e-300))
                rest[:, start] = np.where(start < lengths, np.where(ways.max(axis=1) == -np.inf, -np.inf, here), rest[:, start])
            begin = np.arange(width)[:, None] - np.arange(most)[None, :] + most - 1  # in at, of the edge that ends after each place
            share = np.exp(at[:, np.maximum(begin, 0)] + weight + rest[:, 1 : width + 1, None] - whole[:, None, None])
            found = piece >= 0
            uses[: self.n] += np.bincount(piece[found], share[found], self.n)
            alone = np.exp(at[:, most - 1 : most - 1 + width] + spelled + rest[:, 1 : width + 1] - whole[:, None])
            alone[np.arange(width)[None, :] >= lengths[:, None]] = 0.0
            known, where = np.unique(codes, return_inverse=True)
            for c, n in zip(known.tolist(), np.bincount(where.ravel(), alone.ravel(), len(known)).tolist(), strict=True):
                np.add.at(uses, self.n + _bytes_of(c), n)
        return uses


def _bytes_of(code: int) -> np.ndarray:
    """A character's bytes in UTF-8."""
    return np.frombuffer(chr(MARK if code == _ORDINARY_MARK else code).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)


class Model:
    """The lattice, the training counts that all tasks need, and how a token's probability follows from its count."""

    def __init__(self, lattice: Lattice, tokens: int, kinds: int, once: int, twice: int, documents: int):
        self.lattice, self.tokens, self.documents = lattice, tokens, documents
        self.kinds = kinds
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        # the weight of the lattice: what the discounts of words and end leave; without training, even odds
        self.log_rest = math.log10(self.discount * kinds / tokens) if tokens else math.log10(0.5)
        self.frequent: dict[str, tuple[int, float]] = {}
        self.least = 0

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))

    def score(self, n: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """log10 of the discounted share of count n plus the lattice's part."""
        share = np.maximum(n - self.discount, 0) / max(self.tokens, 1)
        with np.errstate(divide="ignore"):
            return np.where(n > 0, np.log10(share + 10.0 ** (self.log_rest + log_lattice)), self.log_rest + log_lattice)

    def end(self) -> tuple[float, float]:
        """Base and score of a text's end."""
        score = math.log10((self.documents - self.discount) / self.tokens) if self.documents else math.log10(0.5)
        return float(self.base(np.array([self.documents]))[0]), score

    def base_column(self, n: Column) -> Column:
        return F.log10((n + F.lit(0.1)) / F.lit(self.tokens + 0.1 * (self.kinds + 1)))

    def score_column(self, n: Column, log_lattice: Column) -> Column:
        below = F.lit(self.log_rest) + log_lattice
        share = (n - F.lit(self.discount)) / F.lit(float(max(self.tokens, 1)))
        return F.when(n > 0, F.log10(share + F.pow(F.lit(10.0), below))).otherwise(below)


def word_counts(texts: DataFrame) -> DataFrame:
    """text to word, n."""

    def run(batches):
        for table in chunks(batches):
            words, _ = split_words(column(table, "text"))
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _fitted(counts: DataFrame, lattice: Lattice, first: np.ndarray, rounds: int) -> Lattice:
    """Weights by expectation maximisation over the distinct words, each once: the lattice spells what counts do not know."""
    context = counts.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(lattice)

        def run(batches, held=held):
            total = np.zeros(len(held.value.log_p))
            for batch in batches:
                total += held.value.expected(batch.column(0).to_pylist())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

        uses = counts.select("word").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        total = PRIOR * np.exp(first)
        total[uses["piece"].to_numpy()] += uses["uses"].to_numpy()
        lattice.log_p = np.log(total / total.sum())
    return lattice


def fit(documents: DataFrame, learn: Column, scratch: Scratch, path: str | None = None, rounds: int = ROUNDS, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model of the rows where learn holds, and the table of their words' counts (word, n)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, log_p, log_bytes = vocabulary(path)
    lattice = Lattice(pieces, log_p, log_bytes)
    texts = documents.where(learn).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = scratch.save(word_counts(texts), "counts")
    ends = texts.count()
    row = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tokens, kinds, once, twice = (int(v or 0) for v in row)
    model = Model(_fitted(counts, lattice, lattice.log_p.copy(), rounds) if kinds else lattice, tokens + ends, kinds + (ends > 0), once + (ends == 1), twice + (ends == 2), ends)
    # the lowest power of two that no more than `frequent` words reach
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    by_size = {r["k"]: r["count"] for r in short.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    above, level = 0, max(by_size, default=-1) + 1
    while level > 0 and above + by_size.get(level - 1, 0) <= frequent:
        level -= 1
        above += by_size.get(level, 0)
    model.least = 1 << level
    common = short.where(F.col("n") >= model.least).toArrow()
    words = common.column("word").to_pylist()
    model.frequent = dict(zip(words, zip(common.column("n").to_pylist(), (model.lattice.log_marginals(words) / math.log(10)).tolist(), strict=True), strict=True))
    return model, counts


def score(documents: DataFrame, model: Model, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """documents (doc_id, text) to doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for each row.

    A token is a word or the end of a text, so a null or empty text has one. Rows that repeat a doc_id, or have none,
    each keep their row. Words of any length are scored whole. Without training rows every token counts as unknown. Other
    columns are ignored; an empty table gives no rows.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    rare = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64()), ("lattice", pa.float64())]))

    def run(batches):
        known = held.value
        base_end, score_end = known.end()
        for table in chunks(batches):
            words, ends = split_words(column(table, "text"))
            coded = words.dictionary_encode()
            names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            looked = [known.frequent.get(w) for w in names]
            n = np.array([f[0] if f else 0 for f in looked], np.int64)
            lattice = np.array([f[1] if f else 0.0 for f in looked], np.float64)
            other = np.flatnonzero(n == 0)
            lattice[other] = known.lattice.log_marginals([names[k] for k in other.tolist()]) / math.log(10)
            common = n > 0
            base, own = np.where(common, known.base(n), 0.0), np.where(common, known.score(n, lattice), 0.0)

            def sums(of, index=index, ends=ends):
                total = np.concatenate([[0], np.cumsum(of[index])])
                return total[ends[1:]] - total[ends[:-1]]

            docs = np.repeat(np.arange(len(table)), np.diff(ends))
            far = ~common[index]
            pairs, times = np.unique(docs[far] * max(len(names), 1) + index[far], return_counts=True)
            doc, word = np.divmod(pairs, max(len(names), 1))
            cuts = np.searchsorted(doc, np.arange(len(table) + 1)).astype(np.int32)
            listed = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(times), pa.array(lattice[word])], fields=list(rare.value_type))
            yield pa.RecordBatch.from_arrays(
                [column(table, "doc_id"), pa.array(np.diff(ends) + 1), pa.array(sums(common.astype(np.int64)) + (known.documents > 0)), pa.array(sums(base) + base_end), pa.array(sums(own) + score_end), pa.ListArray.from_arrays(pa.array(cuts), listed)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,times:long,lattice:double>>")
    seen = scratch.save(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    met = seen.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.lattice")
    few = counts.where((F.col("n") < model.least) | (F.octet_length("word") > FREQUENT_BYTES))
    met = met.join(few, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * model.base_column(F.col("n"))).alias("more_base"),
        F.sum(F.col("times") * model.score_column(F.col("n"), F.col("lattice"))).alias("more_score"),
    )
    joined = seen.drop("rare").join(met, "row", "left")
    added = lambda one, more: (F.col(one) + F.coalesce(F.col(more), F.lit(0))).alias(one)
    return joined.select("doc_id", "n_tokens", added("n_known", "more"), F.lit(model.tokens).cast("long").alias("train_tokens"), added("base_score", "more_base"), added("score", "more_score"))


def lattice_scores(documents: DataFrame, held_out: Column, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """score() of all documents by a model of those where held_out does not hold."""
    scratch = Scratch(documents.sparkSession, "lattice")
    model, counts = fit(documents, ~held_out, scratch, path, frequent=frequent)
    return score(documents, model, counts, scratch)


def query(documents: DataFrame, held_out: Column) -> DataFrame:
    """lattice_scores with held_out, a function of doc_id alone."""
    return lattice_scores(documents, held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
