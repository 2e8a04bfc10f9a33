"""Command lines: phrase-indices, wsd, regression."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.functions.text import genre
from verbascope.operators import encoders, indices, models, stats, wsd
from verbascope.plans import reports
from verbascope.sources import files, workbooks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verbascope")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("phrase-indices", help="indices of answers or scripts, and their correlation with the score")
    one.add_argument("--hit-detail", required=True)
    one.add_argument("--ambig", required=True)
    one.add_argument("--unit", choices=["answer", "script"], default="answer")
    one.add_argument("--out-indices")
    one.add_argument("--out-corr")
    two = commands.add_parser("wsd", help="evaluation of sense disambiguation")
    two.add_argument("--encoder", choices=["tfidf", "bert", "bert_sentence", "bert_phrase"], default="tfidf")
    two.add_argument("--strategy", choices=["def", "def+ex"], default="def+ex")
    two.add_argument("--bert-model")
    two.add_argument("--spacy-model", default="en_core_web_trf")
    two.add_argument("--data", required=True)
    two.add_argument("--out")
    three = commands.add_parser("regression", help="word block against word and phrase block, overall and by genre")
    three.add_argument("--essays", required=True)
    three.add_argument("--dictionary", required=True)
    three.add_argument("--phrase-indices", required=True)
    three.add_argument("--out", default="word_indices.csv")
    three.add_argument("--survival", action="store_true", help="p from the tail itself")
    return top


def phrase_indices(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    suffix = "" if args.unit == "answer" else "_perscript"
    hits = indices.resolved(workbooks.read_hits(spark, args.hit_detail), indices.sense_levels(workbooks.read_inventory(spark, args.ambig)))
    rows = indices.phrase_indices(hits, args.unit)
    reports.save_phrase_indices(rows, args.out_indices or f"phrase_indices{suffix}.csv")
    table = stats.correlation_table(stats.correlations(rows))
    reports.save_csv(args.out_corr or f"phrase_corr{suffix}.csv", reports.CORRELATION_COLUMNS, reports.correlation_lines(table))
    print(f"[{args.unit}] groups: {rows.count()}; polysemous hits without a level: {indices.unresolved(hits).first()[0]}")
    print(reports.correlation_console(table))
    return rows


def similarities(
    senses: DataFrame, encoder: str, strategy: str = "def+ex", sentence: Callable[[], encoders.Encoder] | None = None, context: Callable[[], encoders.TokenVectors] | None = None, analyzer: Callable[[], encoders.Analyzer] | None = None
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Similarities of all targets by any of the encoders, and for phrase vectors how they were matched, by target and as a log."""
    targets = senses.select("term", F.col("sense_no").alias("gold_no"), F.col("clean_learner").alias("target"))
    texts = wsd.sense_texts(senses, strategy)
    if encoder == "tfidf":
        return wsd.tfidf_similarities(texts, targets), None, None
    heard = targets.withColumnRenamed("target", "text")
    if encoder == "bert":
        return wsd.vector_similarities(encoders.encoded(texts, sentence), encoders.encoded(heard, sentence)), None, None
    if encoder == "bert_sentence":
        made = [encoders.sentence_vectors(encoders.token_vectors(x, context)) for x in (texts, heard)]
        return wsd.vector_similarities(*made), None, None
    made = []
    for rows in (wsd.anchor_texts(senses), heard):
        rows = encoders.token_vectors(rows, context)
        made.append(encoders.phrase_vectors(encoders.lemma_tokens(rows, analyzer), lemmas="lemmas") if analyzer else encoders.phrase_vectors(rows))
    found = [x.withColumn("matched", F.col("n_tokens") > 0) for x in made]
    matches = found[1].select("term", "gold_no", F.col("matched").alias("target_matched")).join(wsd.sense_match_rates(found[0]), "term")
    # an example is encoded anew for each target of its phrase, of which there are as many as senses
    senses_of = senses.select("term", "n_senses").distinct()
    columns = ("term", "label", "text", "n_tokens", "span_by", "weight")
    said = made[0].join(senses_of, "term").withColumns({"label": F.lit("sense_ex"), "weight": F.col("n_senses")}).select(*columns)
    log = wsd.match_log(said.union(made[1].withColumns({"label": F.lit("target"), "weight": F.lit(1).cast("long")}).select(*columns)), analyzer is not None)
    return wsd.vector_similarities(wsd.anchors(made[0]), made[1]), matches, log


def evaluate(
    spark: SparkSession, args: argparse.Namespace, sentence: Callable[[], encoders.Encoder] | None = None, context: Callable[[], encoders.TokenVectors] | None = None, lemmas: Callable[[], encoders.Analyzer] | None = None
) -> DataFrame:
    """Evaluates a workbook; without factories the optional libraries' models are used."""
    senses = wsd.evaluable(wsd.sense_inventory(workbooks.read_inventory(spark, args.data)))
    model, spacy = args.bert_model, args.spacy_model
    analyzer, suffix = None, {"tfidf": f"tfidf_{args.strategy}", "bert": f"bert_minilm_{args.strategy}", "bert_sentence": f"bert_sentence_{args.strategy}", "bert_phrase": "bert_phrase"}[args.encoder]
    if args.encoder == "bert_phrase":
        lemmas = lemmas or (lambda: models.LemmaModel(spacy))
        try:
            lemmas()
        except Exception as why:  # noqa: BLE001  any failure of the optional library
            print(f"no lemmas, words are matched as they stand: {why}")
        else:
            analyzer, suffix = lemmas, "bert_phrase_lemma"
    name = {"tfidf": "TF-IDF", "bert": model or "all-MiniLM-L6-v2"}.get(args.encoder, model or "bert-base-uncased")
    found, matches, log = similarities(senses, args.encoder, args.strategy, sentence or (lambda: models.SentenceModel(model or "all-MiniLM-L6-v2")), context or (lambda: models.ContextModel(model or "bert-base-uncased")), analyzer)
    details = wsd.detailed(wsd.predicted(found), senses, matches).cache()
    strategy = reports.PHRASE_MODE if args.encoder == "bert_phrase" else args.strategy
    print(reports.evaluation_console(details, name, strategy, log))
    Path(args.out or f"wsd_eval_{suffix}.xlsx").write_bytes(reports.evaluation_workbook(details, name, strategy))
    return details


def regression(spark: SparkSession, args: argparse.Namespace, analyzer: Callable[[], encoders.Analyzer] = models.TaggedWords) -> DataFrame:
    essays, broken = files.read_essays(spark, args.essays)
    words = indices.counted_levels(encoders.content_words(essays, analyzer), files.read_dictionary(spark, args.dictionary))
    rows = indices.scored(indices.word_indices(words), essays)
    both = indices.joined_indices(rows, files.read_indices(spark, args.phrase_indices))
    kinds = both.join(essays.select("essay_id", genre(F.col("paragraphs")).alias("genre")), "essay_id")
    table = stats.hierarchical(kinds, survival=args.survival)
    print(f"essays that couldn't be read: {broken.count()}")
    print(reports.genre_line(kinds))
    print(reports.regression_console(table))
    reports.save_word_indices(both, args.out)
    return table


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("verbascope").getOrCreate()
    {"phrase-indices": phrase_indices, "wsd": evaluate, "regression": regression}[args.command](spark, args)


if __name__ == "__main__":
    main()
