"""Word alignment by similarity of given vectors.

tokens: pair_id, side (src, tgt), tok_idx, token, vec. Pairs are sentences: a pair's tokens are joined
with each other by pair_id, never across pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPECIAL = ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]", "<s>", "</s>", "<pad>", "<unk>", "<mask>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_matrix(tokens: DataFrame, decimals: int = 4) -> DataFrame:
    """(pair_id, src, tgt, sim) of all pairs of normalised vectors; those of different length give null."""
    s = tokens.where("side = 'src'").select("pair_id", F.col("tok_idx").alias("src"), F.col("vec").alias("_a"))
    t = tokens.where("side = 'tgt'").select("pair_id", F.col("tok_idx").alias("tgt"), F.col("vec").alias("_b"))
    sim = F.when(F.size("_a") == F.size("_b"), F.round(_dot(F.col("_a"), F.col("_b")), decimals) + F.lit(0.0))
    return s.join(t, "pair_id").select("pair_id", "src", "tgt", sim.alias("sim"))


def _best(sim: DataFrame, by: str, *order: Column) -> DataFrame:
    return sim.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", by).orderBy(F.desc("sim"), *order))).where("_n = 1").drop("_n")


def argmax_source(sim: DataFrame) -> DataFrame:
    """The best target of each source token, the last of equal ones."""
    return _best(sim, "src", F.desc("tgt"))


def argmax_target(sim: DataFrame) -> DataFrame:
    """The best source of each target token, the first of equal ones."""
    return _best(sim, "tgt", F.asc("src"))


def intersection(sim: DataFrame) -> DataFrame:
    return argmax_source(sim).join(argmax_target(sim).select("pair_id", "src", "tgt"), ["pair_id", "src", "tgt"], "left_semi")


def itermax(sim: DataFrame, min_sim: float = 0.3) -> DataFrame:
    """Greedy one-to-one matching: the largest similarity left over, by row and column on ties, until under min_sim.

    One pass over a pair's edges in that order, with the sets of used rows and columns: the same as
    searching for the largest again and again.
    """
    rows = sim.where(F.col("sim") >= min_sim).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "src", "tgt"))).alias("e"))
    kind = "struct<s:array<int>,t:array<int>,out:array<struct<src:int,tgt:int,sim:double>>>"
    start = F.expr(f"cast(named_struct('s', array(), 't', array(), 'out', array()) as {kind})")

    def step(acc: Column, x: Column) -> Column:
        taken = F.array_contains(acc.s, x.src) | F.array_contains(acc.t, x.tgt)
        more = F.struct(F.array_append(acc.s, x.src).alias("s"), F.array_append(acc.t, x.tgt).alias("t"), F.array_append(acc.out, F.struct(x.src.alias("src"), x.tgt.alias("tgt"), (-x.neg).alias("sim"))).alias("out"))
        return F.when(taken, acc).otherwise(more.cast(kind))

    return rows.select("pair_id", F.inline(F.aggregate("e", start, step).out))


def without_special(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("token").isin(*SPECIAL))


def words(tokens: DataFrame, kind: str = "wordpiece") -> DataFrame:
    """Tokens to words: (pair_id, side, tok_idx, w_idx, piece), special tokens left out.

    wordpiece: ## continues a word; sentencepiece: ▁ starts one; bpe: each token is one. A continuation
    with nothing before it starts a word.
    """
    t, token = without_special(tokens), F.col("token")
    starts = {"wordpiece": ~token.startswith("##"), "sentencepiece": token.startswith("▁"), "bpe": F.lit(True)}[kind]
    piece = {"wordpiece": F.regexp_replace(token, "^##", ""), "sentencepiece": F.regexp_replace(token, "^▁", ""), "bpe": token}[kind]
    w = Window.partitionBy("pair_id", "side").orderBy("tok_idx")
    n = F.sum(F.when(starts | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w)
    # an orphan continuation is the first row, so that it starts word 0
    return t.withColumn("_w", n).select("pair_id", "side", "tok_idx", (F.col("_w") - 1).cast("int").alias("w_idx"), piece.alias("piece"))


def word_texts(word_tokens: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "piece"))), lambda x: x.piece), "")
    return word_tokens.groupBy("pair_id", "side", "w_idx").agg(text.alias("text"), F.count(F.lit(1)).alias("n_tokens"))


def word_edges(edges: DataFrame, word_tokens: DataFrame) -> DataFrame:
    """Token edges as distinct edges between words, with the best similarity; edges of special tokens go."""
    s = word_tokens.where("side = 'src'").select("pair_id", F.col("tok_idx").alias("src"), F.col("w_idx").alias("src_word"))
    t = word_tokens.where("side = 'tgt'").select("pair_id", F.col("tok_idx").alias("tgt"), F.col("w_idx").alias("tgt_word"))
    j = edges.join(s, ["pair_id", "src"]).join(t, ["pair_id", "tgt"])
    return j.groupBy("pair_id", "src_word", "tgt_word").agg(F.max("sim").alias("sim"))


def align(tokens: DataFrame, kind: str = "wordpiece", strategy: str = "itermax", min_sim: float = 0.3) -> DataFrame:
    """Vectors to word edges."""
    sim = cosine_matrix(tokens)
    edges = {"itermax": lambda: itermax(sim, min_sim), "intersection": lambda: intersection(sim), "source": lambda: argmax_source(sim), "target": lambda: argmax_target(sim)}[strategy]()
    return word_edges(edges, words(tokens, kind))
