"""The whole pipeline: records, candidates, two models, the graph, decision, result lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import textnorm as n
from kinlink.functions.textnorm import words
from kinlink.functions.translit import transliterate
from kinlink.operators import decide as d
from kinlink.operators import fine, graph, metrics, model, rates, simjoin, splits
from kinlink.operators.features import FEATURES, stage1_features
from kinlink.operators.relational import dense_rid
from kinlink.operators.tokens import indexed, name_marked, tokenize
from kinlink.operators.windows import query_context
from kinlink.sources.tables import TRUTH, load_config, read_tsv, save_config, settled, truth_pairs, write_lists

CARRIED = ["n_tset", "n_ratio", "sk_ratio", "cos_name", "cos_addr", "cos_num", "a_tset", "bs_f", "br_f", "q_noaddr", "q_native", "num_first_eq", "legal_eq", "q_ncand"]
CONTEXT = ["p", "q_gap", "q_max", "q_sum", "q_n10", "q_rank", "e_nwin_other", "e_psum", "e_rank", "e_pmax"]


def normalise(raw: DataFrame, native_scripts: bool = True) -> DataFrame:
    """raw (entity_id, business_name, business_address, country, src) with the normalised columns."""
    name, addr = F.col("business_name"), F.col("business_address")
    if native_scripts:
        name, addr = transliterate(name), transliterate(addr)
    x = raw.select("*", name.alias("__n"), addr.alias("__a"))
    x = x.select("*", n.name_parts(F.col("__n")).alias("__np"), n.addr_parts(F.col("__a"), F.col("country")).alias("__ap"))
    return x.select(
        *[n.country_clean(F.col(c)).alias(c) if c == "country" else F.col(c) for c in raw.columns],
        "__np.name_full", "__np.core", "__np.core_sk", "__np.legal", "__np.alt", "__ap.addr", F.array_join("__ap.nums", " ").alias("nums"), "__ap.state",
    )


def records(sources: dict[int, DataFrame]) -> DataFrame:
    """Normalised records of all sources with their place as rid."""
    tables = [df.withColumn("src", F.lit(src).cast("int")) for src, df in sorted(sources.items())]
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return settled(dense_rid(normalise(out), ["src", "entity_id"]))


def block(rec: DataFrame, k_full: int = 20, k_name: int = 10, raw: bool = True) -> DataFrame:
    return simjoin.candidates(lambda: settled(name_marked(tokenize(rec, True, raw, (indexed(),)))), rec.where("src = 1"), rec.where("src <> 1"), k_full, k_name)


@dataclass
class Linker:
    """Settings and fitted parts; fit() on labelled records, then link() others."""

    stage1: dict = field(default_factory=lambda: dict(model.STAGE1))
    stage2: dict = field(default_factory=lambda: dict(model.STAGE2))
    prune: float = 0.001
    min_cos: float = 0.6
    least: int = 20
    shift: float = 1.0
    stage: int = 2
    rule: str = "expected"
    threshold: float = 0.5
    model1: object = None
    model2: object = None
    word_rates: DataFrame | None = None
    sig_rates: DataFrame | None = None

    def score1(self, pairs: DataFrame, rec: DataFrame) -> DataFrame:
        return model.predict(self.model1, stage1_features(pairs, rec)).where(F.col("p") >= self.prune)

    def context(self, scores: DataFrame, rec: DataFrame, links: DataFrame) -> DataFrame:
        """Second-stage rows: context, carried, fine and graph features of scored pairs."""
        key = ["q_rid", "e_rid"]
        x = query_context(scores)
        fine_part = settled(fine.fine_features(x, rec, self.word_rates, self.sig_rates))
        return settled(x.join(fine_part, key).join(settled(graph.graph_features(links, scores, x, rec)), key))

    def learn_rates(self, feats: DataFrame, rec: DataFrame, gt: DataFrame) -> None:
        close = splits.label(feats.where(F.col("cos_name") >= self.min_cos).select("q_rid", "e_rid"), gt)
        side = lambda s: rec.select(F.col("rid").alias(f"{s}_rid"), words(F.col("core")).alias(f"t{s}"), rates.first_numbers(F.col("nums")).alias(f"n{s}"), F.col("legal").alias(f"l{s}"), F.lower("country").alias(f"c{s}"))
        p = close.join(side("q"), "q_rid").join(side("e"), "e_rid")
        self.word_rates = settled(rates.extra_word_rates(p, least=self.least))
        f, c = rates.signatures(F.col("tq"), F.col("te"), F.col("nq"), F.col("ne"), F.col("lq"), F.col("le"), F.col("cq"))
        self.sig_rates = settled(rates.signature_rates(p.select("y", f.alias("fine"), c.alias("coarse")), least=self.least))

    def fit(self, rec: DataFrame, gt: DataFrame, percent: int = 20) -> dict:
        """Both models and the prior shift; returns what was measured on held-out entities."""
        cand = settled(block(rec))
        held, held_q, train_q = map(settled, splits.split_design(rec.where("src = 1"), cand, gt, percent))
        feats = settled(stage1_features(cand.join(train_q, "q_rid", "left_semi"), rec))
        self.model1 = model.train(splits.label(feats, gt), FEATURES, **self.stage1)
        self.learn_rates(feats, rec, gt)
        links = settled(simjoin.neighbours(settled(tokenize(rec)), rec.where("src <> 1")))
        scores = settled(self.score1(cand.join(held_q, "q_rid", "left_semi"), rec))
        x = settled(splits.label(self.context(scores, rec, links), gt))
        self.model2 = model.train(x, [*CONTEXT, *CARRIED, *fine.FINE, *graph.FEATURES], **self.stage2)
        second = settled(model.predict(self.model2, x, "p2").select("q_rid", "e_rid", F.col("p2").alias("p")))
        truth = gt.join(held.withColumnRenamed("e_rid", "true_e"), "true_e", "left_semi")
        grid = metrics.prior_shift_search(second, gt, held, d.decide, truth=truth).collect()
        found = {row["r"]: row["f05"] for row in grid}
        self.shift = next(row["r"] for row in grid if row["chosen"])
        self.choose(scores.select("q_rid", "e_rid", "p"), second, truth, held)
        return found

    def choose(self, first: DataFrame, second: DataFrame, truth: DataFrame, held: DataFrame) -> None:
        """The stage and the rule (threshold or expected F0.5) that do best on the same held-out entities."""
        best = lambda s: metrics.threshold_sweep(s, truth, held, 20, 95).agg(F.max(F.struct("f05", (-F.col("thr")).alias("t")))).first()[0]
        one, two = best(first), best(second)
        exact = metrics.macro_f05(d.decide(second).join(held, "e_rid", "left_semi"), truth, held).first()[0]
        self.stage = 2 if max(two["f05"], exact) > one["f05"] else 1
        self.threshold = -(two if self.stage == 2 else one)["t"]
        self.rule = "expected" if self.stage == 2 and exact >= two["f05"] else "threshold"

    def config(self) -> dict:
        """The settings that a later run needs, for save_config()."""
        return {"stage": self.stage, "rule": self.rule, "thr": self.threshold, "shift": self.shift, "prune": self.prune}

    def save(self, spark: SparkSession, path: str) -> None:
        """Models, rates and settings under path."""
        self.model1.write().overwrite().save(f"{path}/model1")
        self.model2.write().overwrite().save(f"{path}/model2")
        self.word_rates.write.mode("overwrite").parquet(f"{path}/word_rates")
        self.sig_rates.write.mode("overwrite").parquet(f"{path}/sig_rates")
        save_config(spark, self.config(), f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Linker:
        c = load_config(spark, f"{path}/config")
        return cls(
            prune=c["prune"], shift=c["shift"], stage=c["stage"], rule=c["rule"], threshold=c["thr"],
            model1=PipelineModel.load(f"{path}/model1"), model2=PipelineModel.load(f"{path}/model2"),
            word_rates=spark.read.parquet(f"{path}/word_rates"), sig_rates=spark.read.parquet(f"{path}/sig_rates"),
        )

    def link(self, rec: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Decided and all scored pairs of rec."""
        scores = settled(self.score1(settled(block(rec)), rec))
        links = settled(simjoin.neighbours(settled(tokenize(rec)), rec.where("src <> 1")))
        blank = lambda new: self.score1(new.select("q_rid", "e_rid", F.lit(0.0).alias("bs_f"), F.lit(99).alias("br_f"), F.lit(0.0).alias("bs_n"), F.lit(99).alias("br_n")), rec)
        if self.stage == 1:
            return d.assign(scores, self.threshold), scores.select("q_rid", "e_rid", "p")
        scores = settled(graph.augment(scores, links, blank))
        second = settled(model.predict(self.model2, self.context(scores, rec, links), "p2").select("q_rid", "e_rid", d.odds_shift(F.col("p2"), self.shift).alias("p")))
        return (d.decide(second) if self.rule == "expected" else d.assign(second, self.threshold)), second


def main(spark: SparkSession, base: str, out: str) -> None:
    """Training on {base}/train_*, results for {base}/test_* in out."""
    of = lambda split: records({s: read_tsv(spark, f"{base}/{split}_source{s}.tsv") for s in (1, 2, 3)})
    rec = of("train")
    linker = Linker()
    linker.fit(rec, truth_pairs(read_tsv(spark, f"{base}/train_ground_truth.tsv", TRUTH), rec))
    linker.save(spark, f"{out}/model")
    test = of("test")
    decided, scored = linker.link(test)
    write_lists(decided, test, "matched_entity_ids", f"{out}/matching_results.tsv")
    write_lists(scored, test, "candidate_entity_ids", f"{out}/candidate_pairs.tsv")
