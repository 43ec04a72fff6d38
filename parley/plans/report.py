"""Reports in Markdown, of results that are a few rows: rendered on the driver. A summary row that is known already can be given as `whole`."""

from pyspark.sql import DataFrame, Row

from parley.functions import lexicon as lx
from parley.operators import errors, metrics


def percent(x: float, digits: int = 2) -> str:
    return f"{100 * x:.{digits}f}%"


def table(head: list[str], rows: list[list]) -> str:
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def multiclass(rows: DataFrame, labels: list[str] = lx.LABELS, whole: Row | None = None) -> str:
    """Summary line and a table of the classes in the order of labels; rows has actual and predicted."""
    whole = whole or metrics.multiclass(rows, labels).first()
    found = {r.label: r for r in metrics.per_class(rows, labels).collect()}
    body = [[f"`{x}`", percent(found[x].precision, 1), percent(found[x].recall, 1), percent(found[x].f1, 1), found[x].support] for x in labels]
    head = f"Accuracy {percent(whole.accuracy)}, macro-F1 {percent(whole.macro_f1)}, weighted F1 {percent(whole.weighted_f1)}"
    return head + "\n\n" + table(["label", "precision", "recall", "F1", "support"], body)


def confusion(rows: DataFrame, labels: list[str] = lx.LABELS, width: int = 24) -> str:
    """Numbered columns in plain text, with row and column totals; long names are cut."""
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion(rows, labels).collect()}
    short = [x if len(x) <= width else x[: width - 2] + ".." for x in labels]
    line = lambda name, values: f"{name:<{width + 6}}" + "".join(f"{v:>7}" for v in values)
    key = [f"[{i}] {x}" for i, x in enumerate(labels, 1)]
    counts = [[cells[a, p] for p in labels] for a in labels]
    body = [line(f"[{i}] {name}", [*n, sum(n)]) for i, (name, n) in enumerate(zip(short, counts), 1)]
    totals = [sum(n) for n in zip(*counts)]
    return "\n".join(
        [*key, "", line("actual \\ predicted", [*(f"[{i}]" for i in range(1, len(labels) + 1)), "total"]), *body, line("total", [*totals, sum(totals)])]
    )


def binary(rows: DataFrame, whole: Row | None = None) -> str:
    m = whole or metrics.binary(rows).first()
    lines = [f"- {name}: {percent(getattr(m, name))}" for name in ("accuracy", "precision", "recall", "f1")]
    body = [["escalate", m.tp, m.fn, m.tp + m.fn], ["keep", m.fp, m.tn, m.fp + m.tn], ["total", m.tp + m.fp, m.fn + m.tn, m.total]]
    return "\n".join(lines) + "\n\n" + table(["actual", "said escalate", "said keep", "total"], body)


def replies(pairs: DataFrame, whole: Row | None = None) -> str:
    found = whole or metrics.reply_metrics(pairs).first()
    if found is None:
        return "No replies."
    lines = [f"- {name}: {percent(found[key])}" for name, key in (("ROUGE-1", "rouge_1"), ("ROUGE-2", "rouge_2"), ("ROUGE-L", "rouge_l"), ("BLEU-1", "bleu"))]
    return "\n".join([*lines, f"- mean length: {found.mean_tokens:.1f} words, {found.mean_chars:.1f} characters"])


def error_report(scored: DataFrame, position: str = "pos", whole: Row | None = None) -> str:
    """Counts, modes with their first examples, and the most frequent confusions."""
    whole = whole or errors.roll_up(scored).first()
    modes = sorted(errors.modes(scored).collect(), key=lambda r: (-r.n, r.failure_mode))
    shown: dict = {}
    for r in errors.samples(scored, position).orderBy(position).collect():
        shown.setdefault(r.failure_mode, []).append(r)
    parts = [
        f"{whole.errors} of {whole.total} rows are wrong ({
            percent(whole.errors_share)
        }): {whole.intent_errors} in intent, {whole.escalation_errors} in escalation ({whole.false_positives} false positives, {whole.false_negatives} false negatives)."
    ]
    parts.append(table(["mode", "rows"], [[r.failure_mode, r.n] for r in modes]))
    for r in modes:
        parts.append("\n".join([f"## {r.failure_mode}", *(f"- {x.thread_id}: {x.customer_text!r} ({x.root_cause})" for x in shown.get(r.failure_mode, []))]))
    pairs = errors.top_pairs(scored, position).collect()
    parts.append(table(["gold", "predicted", "rows"], [[r.gold_intent, r.predicted_intent, r.n] for r in pairs]))
    return "\n\n".join(parts)


def sampling(sample: DataFrame, pool: int) -> str:
    """What a stratified sample holds."""
    rows = sample.groupBy("region", "turn_type", "bucket").count().orderBy("region", "turn_type", "bucket").collect()
    total = sum(r["count"] for r in rows)
    return f"{total} of {pool} threads, held out of the search corpus.\n\n" + table(
        ["region", "turns", "bucket", "threads"], [[r.region, r.turn_type, r.bucket, r["count"]] for r in rows],
    )


def agreement(rows: DataFrame) -> str:
    """rows has dimension, t and p."""
    found = metrics.agreement(rows, ["dimension"]).orderBy("dimension").collect()
    return table(
        ["dimension", "n", "Pearson", "Spearman", "kappa", "exact", "within one", "mean error"],
        [
            [
                r.dimension, r.n, f"{r.pearson:.4f}", f"{r.spearman:.4f}", f"{r.kappa:.4f}", percent(r.exact, 1), percent(r.within_one, 1),
                f"{r.mae:.2f}",
            ] for r in found
        ],
    )
