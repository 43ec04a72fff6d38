"""Command line: python -m parley <command>. Commands read and write the files of sources.files."""

import argparse
import importlib
import json
import os
import zlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.operators import agents, assisted, errors, judge, metrics, rules, sampling, threads
from parley.operators.index import SearchIndex
from parley.plans import report
from parley.session import session
from parley.sources import files
from parley.sources.batches import Batches, answered


def _write(folder: str, name: str, text: str) -> None:
    files.write_text(SparkSession.active(), folder, name, text)


def _corpus(spark: SparkSession, path: str, holdout: str | None) -> DataFrame:
    """The threads to search in; none of them may be held out."""
    rows = files.with_position(files.read_jsonl(spark, path, files.THREAD))
    if not holdout:
        return rows
    ids = files.read_lines(spark, holdout)
    kept = sampling.corpus_minus_holdout(rows, ids)
    leaks = [r.thread_id for r in sampling.leaked(kept, ids).limit(5).collect()]
    if leaks:
        raise SystemExit(f"held out, yet searched: {', '.join(leaks)}")
    return kept


def _made(where: str, model: str | None) -> list:
    module, name = where.split(":")
    return getattr(importlib.import_module(module), name)(model)


def _providers(a: argparse.Namespace):
    """What makes the language models' clients: `module:function`, called with --model where they are used; None for the rules alone."""
    if not getattr(a, "provider", None) or getattr(a, "offline", False):
        return None
    return partial(_made, a.provider, a.model)


def _valid(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The labelled rows with their positions; breaches of the rules, or of the order of held-out ids, end the command."""
    gold = files.with_position(files.read_jsonl(spark, a.gold_path, files.GOLD))
    holdout = files.read_lines(spark, a.holdout_path) if a.holdout_path else None
    errors.require_valid(gold, holdout, a.expected or None)
    return gold


def subsample(spark: SparkSession, a: argparse.Namespace) -> None:
    # Threads need several looks at the messages; a CSV file with line ends in its texts can't be split.
    table = os.path.join(a.output_dir, "messages")
    files.read_tweets(spark, a.input).write.mode("overwrite").parquet(table)
    made = threads.rebuild(spark.read.parquet(table), a.brand, a.target_threads)
    path = os.path.join(a.output_dir, "threads")
    files.write_jsonl(made.select(*(c for c in files.THREAD.fieldNames())), path)
    kept = files.read_jsonl(spark, path, files.THREAD)
    files.write_flat_csv(kept, os.path.join(a.output_dir, "threads_csv"))
    inbound = F.size(F.filter("turns", lambda t: t["role"] == "customer"))
    stats = threads.corpus_stats(kept.withColumns({"inbound": inbound, "outbound": F.size("turns") - inbound})).first().asDict()
    stats["turn_histogram"] = {str(r.turn_count): r.n for r in threads.turn_histogram(kept).collect()}
    stats |= {k: str(v) for k, v in threads.date_range(kept).first().asDict().items()}
    files.write_metrics(spark, a.output_dir, "stats.json", stats)


def sample_gold(spark: SparkSession, a: argparse.Namespace) -> None:
    pool = files.with_position(files.read_jsonl(spark, a.input, files.THREAD)).withColumn("bucket", rules.weak_bucket(F.col("customer_text")))
    order = F.array_position(F.array(*map(F.lit, [*lx.BUCKETS, lx.GENERAL_BUCKET])), F.col("bucket"))
    drawn = sampling.round_robin(sampling.regions(pool, "pos"), F.xxhash64(F.lit(a.seed), "thread_id"), order)
    # The sample is as large as its targets say, not as the pool.
    kept = sampling.shuffled(drawn, "thread_id", a.seed).limit(a.target_size).cache()
    blank = [F.lit(None).cast("string").alias(c) for c in ("intent", "escalate_reason", "notes")]
    files.write_jsonl(
        kept.select(
            "thread_id", "customer_tweet_id", "customer_text", "brand_text", "turn_count", "created_at", *blank,
            F.lit(None).cast("boolean").alias("escalate"),
        ),
        a.output_jsonl,
    )
    ids = [r.thread_id for r in kept.select("thread_id").collect()]
    _write(os.path.dirname(a.output_holdout), os.path.basename(a.output_holdout), "\n".join(ids))
    _write(os.path.dirname(a.output_sampling_doc), os.path.basename(a.output_sampling_doc), report.sampling(kept, pool.count()))


def _predicted(kind: str, gold: DataFrame, corpus: DataFrame, providers=None, pace: float = 0.0, index: SearchIndex | None = None) -> DataFrame:
    """gold (with pos) and the predictions of a baseline or agent."""
    asked = gold.select("thread_id", "customer_text")
    none = F.lit(None).cast("string")
    if kind == "agent":
        made = agents.full(asked, corpus, providers=providers, pace=pace, index=index).drop("candidates")
    elif kind == "simple":
        made = agents.simple(asked, corpus)
    elif kind == "trivial":
        made = agents.trivial(asked, gold)
    else:
        made = agents.majority_intent(asked, gold) if kind == "majority_intent" else agents.always_escalate(asked)
        made = made.withColumns({"predicted_reason": none, "predicted_reply": F.lit("")})
    return gold.join(made.drop("customer_text"), "thread_id")


def _scored(rows: DataFrame) -> DataFrame:
    named = rows.withColumns(
        {"gold_intent": F.col("intent"), "gold_escalate": F.col("escalate"), "gold_reason": F.col("escalate_reason"), "gold_reply": F.col("brand_text")}
    )
    pairs = named.select(F.col("thread_id").alias("id"), F.col("gold_reply").alias("reference"), F.col("predicted_reply").alias("hypothesis"))
    return named.join(metrics.reply_scores(pairs).withColumnRenamed("id", "thread_id"), "thread_id")


def _evaluate(scored: DataFrame, folder: str, name: str) -> None:
    scored = scored.cache()
    classes = scored.select(F.col("gold_intent").alias("actual"), F.col("predicted_intent").alias("predicted"))
    decisions = scored.select(F.col("gold_escalate").alias("actual"), F.col("predicted_escalate").alias("predicted"))
    pairs = scored.select(F.col("thread_id").alias("id"), F.col("gold_reply").alias("reference"), F.col("predicted_reply").alias("hypothesis"))
    files.write_jsonl(scored, os.path.join(folder, f"{name}_predictions"))
    intent, escalation = metrics.multiclass(classes, lx.LABELS).first(), metrics.binary(decisions).first()
    replies, wrong = metrics.reply_metrics(pairs).first(), errors.roll_up(scored).first()
    found = {"intent": intent, "escalation": escalation, "replies": replies, "errors": wrong}
    files.write_metrics(SparkSession.active(), folder, f"{name}.json", found)
    parts = [
        "# " + name, report.multiclass(classes, whole=intent), "```\n" + report.confusion(classes) + "\n```",
        report.binary(decisions, escalation), report.replies(pairs, replies), report.error_report(scored, whole=wrong),
    ]
    _write(folder, f"{name}.md", "\n\n".join(parts))
    scored.unpersist()


KINDS = ["agent", "simple", "trivial", "majority_intent", "always_escalate"]


def eval_gold(spark: SparkSession, a: argparse.Namespace) -> None:
    gold = _valid(spark, a)
    if a.replay:
        path = files.resolve(a.replay, [a.output_dir, os.path.dirname(a.gold_path), "reports"])
        cached = files.read_predictions(spark, path)
        rows = files.matched(gold, cached)
        _evaluate(
            _scored(rows.withColumnRenamed("predicted_escalate_reason", "predicted_reason") if "predicted_escalate_reason" in rows.columns else rows),
            a.output_dir, "replay",
        )
        return
    corpus = _corpus(spark, a.corpus, a.holdout_path)
    for kind in KINDS if a.baseline == "all" else [a.baseline]:
        _evaluate(_scored(_predicted(kind, gold, corpus, _providers(a) if a.use_llm else None, a.delay)), a.output_dir, kind)


def run_baseline(spark: SparkSession, a: argparse.Namespace) -> None:
    """The baselines alone."""
    gold, corpus = _valid(spark, a), _corpus(spark, a.corpus, a.holdout_path)
    for kind in KINDS[1:] if a.type == "all" else [a.type]:
        _evaluate(_scored(_predicted(kind, gold, corpus)), a.output_dir, kind)


def audit_gold(spark: SparkSession, a: argparse.Namespace) -> None:
    """Breaches of a labelled set: its rules, labels that must escalate, missing notes, texts that differ from the source's."""
    gold = files.with_position(files.read_jsonl(spark, a.gold_path, files.GOLD))
    source = files.read_jsonl(spark, a.corpus, files.THREAD)
    bare = files.with_position(files.read_jsonl(spark, a.unlabelled, files.GOLD)) if a.unlabelled else None
    holdout = files.read_lines(spark, a.holdout_path) if a.holdout_path else None
    found = errors.violations(gold, holdout, a.expected or None).unionByName(errors.audit(gold, source, bare))
    total = found.count()
    for r in found.orderBy(F.col("pos").asc_nulls_first(), "rule").limit(15).collect():
        print(f"{r.rule}: row {r.pos}, id {r.thread_id}")
    if total:
        raise SystemExit(f"{total} breaches")
    print("no breach")


def check_labels(spark: SparkSession, a: argparse.Namespace) -> None:
    """How far labelling has come; --dump writes all rows as text."""
    gold = files.with_position(files.read_jsonl(spark, a.gold_path, files.GOLD))
    counts = errors.label_counts(gold).first()
    print(f"{counts.labelled} of {counts.total} rows are labelled, numbers {counts.first_labelled} to {counts.last_labelled}")
    for r in errors.label_distribution(gold).orderBy("field", F.col("n").desc(), "value").collect():
        print(f"{r.field} {r.value}: {r.n} ({r.share})")
    lines = errors.label_dump(gold)
    for r in lines.where("status = 'LABELED'").orderBy("number").limit(10).collect():
        print(f"{r.number} {r.thread_id}: {r.customer_short} / {r.brand_short}")
    if a.dump:
        text = F.format_string(
            "%03d %s %s\n  customer: %s\n  brand: %s",
            *(
                F.coalesce(
                    F.col(c).cast("string") if c != "number" else F.col(c), F.lit("") if c != "number" else F.lit(0),
                ) for c in ("number", "thread_id", "status", "customer", "brand")
            ),
        )
        lines.orderBy("number").select(text.alias("value")).write.mode("overwrite").text(a.dump)


def dump_errors(spark: SparkSession, a: argparse.Namespace) -> None:
    scored = spark.read.json(a.predictions)
    files.write_jsonl(errors.records(scored), os.path.join(a.output_dir, "errors"))
    _write(a.output_dir, "errors.md", report.error_report(scored))


def _index(corpus: DataFrame, folder: str, path: str, holdout: str | None) -> SearchIndex:
    """The stored index of the corpus: built once for the files as they are now, whoever asks again."""
    spark = corpus.sparkSession
    seen = files.version(spark.read.text([path, holdout] if holdout else path))
    where = f"{folder}/index-{zlib.crc32(repr(seen).encode()):08x}"
    return SearchIndex.load(spark, where) or SearchIndex.build(agents.searchable(corpus), where)


def online_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers what has no finished result yet, `--batch` rows at a time, so that a stop loses one batch at most; all results are in `results` below the output."""
    gold, store = _valid(spark, a), Batches(spark, a.output_file)
    if a.max_items:
        gold = gold.orderBy("pos").limit(a.max_items)
    if a.no_resume:
        store.clear()
    todo = answered(store, gold).cache()
    corpus = _corpus(spark, a.corpus, a.holdout_path)
    index = _index(corpus, store.folder, a.corpus, a.holdout_path)
    # Batches are by position, so the same rows are in a batch when it is run again.
    starts = [r[0] for r in todo.select((F.floor(F.col("pos") / a.batch) * a.batch).alias("s")).distinct().orderBy("s").collect()]
    for start in starts:
        part = todo.where((F.col("pos") >= start) & (F.col("pos") < start + a.batch))
        store.write(_predicted("agent", part, corpus, _providers(a), a.delay, index), start)
    todo.unpersist()
    found = store.read()
    if found is not None:
        files.write_jsonl(found, f"{store.folder}/results")


def run_agent(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers a text, or the first `--samples` rows of a labelled set."""
    if a.text:
        asked = spark.createDataFrame([("0", a.text, 0)], "thread_id string, customer_text string, pos long")
    elif a.gold_path:
        gold = files.with_position(files.read_jsonl(spark, a.gold_path, files.GOLD))
        asked = gold.orderBy("pos").limit(a.samples).select("thread_id", "customer_text", "pos")
    else:
        raise SystemExit("--text or --gold-path is needed")
    made = agents.full(asked, _corpus(spark, a.corpus, a.holdout_path), a.top_k, _providers(a)).orderBy("pos").drop("pos")
    for row in made.toJSON().toLocalIterator():
        print(json.dumps(json.loads(row), indent=2, ensure_ascii=False))


def run_judge(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.mode == "single":
        one = spark.createDataFrame([(a.query, a.reply, a.intent, a.escalate)], "customer_text string, reply string, predicted_intent string, escalate boolean")
        print(assisted.rate(one, _providers(a), 0.0).toJSON().first())
        return
    rows = spark.read.json(a.calibration_file).withColumns({"reply": F.col("candidate_reply"), "escalate": F.col("predicted_escalate")})
    rated = assisted.rate(rows, _providers(a), a.delay).cache()
    files.write_jsonl(rated, os.path.join(a.output_dir, "judged"))
    dims = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(d).alias("dimension"), F.col(f"human_{d}").alias("t"), F.col(d).alias("p"),
                ) for d in ("overall", "relevance", "tone", "actionability")
            )
        )
    )
    same = metrics.safety_agreement(rated, "human_safety", "safe").first().agreement
    _write(a.output_dir, "agreement.md", report.agreement(rated.select(dims.alias("x")).select("x.*")) + f"\n\nSafety: {report.percent(same)} equal.")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parley")
    top.add_argument("--master", help="as for spark-submit")
    sub = top.add_subparsers(dest="command", required=True)

    def command(run, name: str, **flags) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        p.set_defaults(run=run)
        for flag, kind in flags.items():
            option = "--" + flag.replace("_", "-")
            if kind is bool:
                p.add_argument(option, action="store_true")
            elif isinstance(kind, list):
                p.add_argument(option, choices=kind, default=kind[0])
            elif isinstance(kind, type):
                p.add_argument(option, type=kind, required=True)
            else:
                p.add_argument(option, type=type(kind) if kind is not None else str, default=kind)

    command(subsample, "subsample", input=str, output_dir=str, brand=str, target_threads=5000)
    command(sample_gold, "sample-gold", input=str, output_jsonl=str, output_holdout=str, output_sampling_doc=str, target_size=200, seed=42)
    model = dict(provider=None, model=None)
    command(
        eval_gold, "eval-gold", gold_path=str, corpus=None, holdout_path=None, expected=0, output_dir=str, baseline=["all", *KINDS],
        replay=None, use_llm=bool, delay=0.0, **model,
    )
    command(
        run_baseline, "run-baseline", gold_path=str, corpus=str, holdout_path=None, expected=0, output_dir=str,
        type=["simple", "trivial", "majority_intent", "always_escalate", "all"],
    )
    command(audit_gold, "audit-gold", gold_path=str, corpus=str, unlabelled=None, holdout_path=None, expected=0)
    command(check_labels, "check-labels", gold_path=str, dump=None)
    command(dump_errors, "dump-errors", predictions=str, output_dir=str)
    command(
        online_eval, "online-eval", gold_path=str, corpus=str, holdout_path=None, expected=0, output_file=str, max_items=0, batch=10,
        delay=0.35, no_resume=bool, **model,
    )
    command(run_agent, "run-agent", corpus=str, holdout_path=None, text=None, gold_path=None, samples=3, top_k=3, offline=bool, **model)
    command(
        run_judge, "run-judge", mode=["single", "calibrate"], query="", reply="", intent="other", escalate=bool, calibration_file=None,
        output_dir=".", delay=4.5, offline=bool, **model,
    )
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(a.master), a)
