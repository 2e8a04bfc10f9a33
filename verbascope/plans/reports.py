"""Small exports made on the driver: CSV files with a byte order mark, the workbook of an evaluation, console tables.

They take tables of as many rows as there are indices, or a report a person
reads; large results are written by Spark.
"""

from __future__ import annotations

import csv
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.functions.text import ESSAY, LETTER, NARRATIVE, REPORT, number_order
from verbascope.operators import wsd
from verbascope.operators.indices import PHRASE_COLUMNS, WORD_COLUMNS
from verbascope.sources.workbooks import SHEET_ROWS, workbook

# Names, headers and labels of the reports.
GENRE_NAMES = {LETTER: "书信", ESSAY: "议论·文章", NARRATIVE: "记叙", REPORT: "报告", "overall": "总体"}
CORRELATION_COLUMNS = ("index", "mean", "sd", "n", "r_senseaware", "p", "r_v12_fixed", "r_docx_v6")
DETAIL_SHEET, SUMMARY_SHEET, ABLATION_SHEET = "消歧明细", "汇总", "消融分析"
DETAIL_HEADERS = ("短语", "义项数", "学习者例句", "金标序号", "金标释义", "预测序号", "预测释义", "是否正确", "是否平局", "相似度(各义项)", "sim差值", "等级", "短语定位", "义项例句匹配率")
PHRASE_MODE = "phrase-from-examples (bert_phrase mode)"
# Formats of lines of the reports.
CORRELATION_HEAD = f"{'指标':22}{'Mean':>8}{'SD':>7}{'N':>6}{'senseAware_r':>13}{'p':>9}   {'固定级r':>8}{'docx_v6':>9}"
CORRELATION_LINE = "{:22}{:>8}{:>7}{:6d}{:>13}{:<3}{:>8}   {:>8}{:>9}"
REGRESSION_LINE = "  [{:22}] n={:4d} | R²词={:.4f}  R²词+短语={:.4f}  ΔR²={:+.4f}  p={:.4g} {}  (仅短语R²={:.4f})"
REGRESSION_SKIPPED = "  [{}] n={} 太小，跳过"
SUMMARY_LABELS = {"encoder": "编码器", "strategy": "义项锚点策略", "accuracy": "总体 Accuracy", "ties": "平局数"}
PER_N_HEAD, PER_N_LABEL = ("义项数", "正确", "总计", "Accuracy"), "{}义项"
ABLATION_HEADS = ("=== 短语 token 定位统计 ===", "=== 消融对比：定位成功 vs 退化为整句向量 ===")
ABLATION_COLUMNS = ("分组", "实例数", "正确数", "Accuracy", "说明")
ABLATION_ROWS = {"matched": ("✓ 短语定位成功", "短语 token 向量有效"), "fallback": ("✗ 退化为整句向量", "词形未匹配，整句 mean-pool 代替")}
ABLATION_RATE, NO_ABLATION = "学习者例句定位成功率", "（仅 --encoder bert_phrase 模式下有消融数据）"
FOUND, NOT_FOUND, NOT_ASKED, RIGHT, WRONG, TIED = "✓matched", "✗fallback", "—", "✓", "✗", "△"
CONSOLE = {
    "encoder": "  编码器: {}", "strategy": "  策略  : {}", "accuracy": "  总体 Accuracy: {:.1%}  ({}/{})", "ties": "  平局数: {}", "per_n": "  按义项数:", "n": "    {} 义项: {:.1%}  ({}/{})",
    "rate": "\n  [消融分析] 短语 token 定位成功率: {:.1%}", "matched": "    ✓ 定位成功: {:.1%}  ({}/{})", "fallback": "    ✗ 退化整句: {:.1%}  ({}/{})",
    "methods": "  [匹配方式] {}", "method": "{}: {}条", "genres": "  体裁分布: {}",
}


def number(value: float | None, form: str) -> str:
    """A number as Python formats it; a missing one as nan."""
    return format(math.nan if value is None else value, form)


def save_csv(path: str, header: Iterable[str], lines: Iterable[Iterable]) -> None:
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(lines)


def save_phrase_indices(rows: DataFrame, path: str) -> None:
    """All index rows in one file, streamed a partition at a time."""
    some = rows.select(*PHRASE_COLUMNS)
    save_csv(path, PHRASE_COLUMNS, (["nan" if x is None else x for x in r] for r in some.toLocalIterator()))


def save_word_indices(rows: DataFrame, path: str) -> None:
    """The same for word indices; without rows there is a header alone."""
    columns = ("essay_id", "total_score", *WORD_COLUMNS)
    save_csv(path, columns, (list(r) for r in rows.select(*columns).toLocalIterator()))


def correlation_lines(table: DataFrame) -> list[list]:
    out = []
    for r in table.orderBy("place").collect():
        known = [("" if r[c] is None else f"{r[c]:.3f}") for c in ("r_v12_fixed", "r_docx_v6")]
        out.append([r["index"], number(r["mean"], ".4f"), number(r["sd"], ".4f"), r["n"], number(r["r_senseaware"], ".4f"), number(r["p"], ".4g"), *known])
    return out


def correlation_console(table: DataFrame) -> str:
    lines = [CORRELATION_HEAD, "-" * 88]
    for r in table.orderBy("place").collect():
        known = ["n.s." if r[c] is None else f"{r[c]:+.3f}" for c in ("r_v12_fixed", "r_docx_v6")]
        found = [number(r[c], form) for c, form in (("mean", ".3f"), ("sd", ".3f"), ("r_senseaware", "+.3f"), ("p", ".3f"))]
        lines.append(CORRELATION_LINE.format(r["index"], found[0], found[1], r["n"], found[2], r["sig"], found[3], *known))
    return "\n".join(lines)


def regression_console(table: DataFrame) -> str:
    """Overall first, then genres in their order; small groups are named as skipped."""
    rows = {r["grp"]: r for r in table.collect()}
    lines = []
    for name in ("overall", LETTER, ESSAY, NARRATIVE, REPORT):
        if (r := rows.get(name)) is None:
            continue
        if r["status"] == "skipped":
            lines.append(REGRESSION_SKIPPED.format(GENRE_NAMES[name], r["n"]))
        else:
            lines.append(REGRESSION_LINE.format(GENRE_NAMES[name], r["n"], r["r2_word"], r["r2_both"], r["delta_r2"], r["p"], "sig" if r["sig"] else "ns", r["r2_phrase"]))
    return "\n".join(lines)


def detail_lines(details: DataFrame) -> list[list]:
    """A line for each target, by phrase and sense number; no more than a sheet has room for."""
    out: list[list] = [list(DETAIL_HEADERS)]
    rows = details.orderBy("phrase", number_order(F.col("gold_no"))).limit(SHEET_ROWS).collect()
    if len(rows) >= SHEET_ROWS:
        raise ValueError(f"an evaluation of {SHEET_ROWS} targets or more doesn't fit a sheet; write its details as a table")
    for r in rows:
        marks = [RIGHT if r["is_correct"] else WRONG, TIED if r["is_tie"] else ""]
        place = {None: NOT_ASKED, True: FOUND, False: NOT_FOUND}[r["target_matched"]]
        rate = NOT_ASKED if r["sense_match_rate"] is None else f"{r['sense_match_rate']:.0%}"
        texts = [plain(r[c]) if c.endswith("_no") else r[c] for c in ("phrase", "n_senses", "target", "gold_no", "gold_def", "pred_no", "pred_def")]
        out.append([*texts, *marks, " | ".join(f"{s:.3f}" for s in r["sims"]), round(r["sim_gap"], 4), r["level"], place, rate])
    return out


def evaluation_workbook(details: DataFrame, encoder: str, strategy: str) -> bytes:
    """Details, summary and ablation of an evaluation as a workbook."""
    total = wsd.summary(details).first()
    values = {"encoder": encoder, "strategy": strategy, "accuracy": f"{total['accuracy']:.1%}  ({total['correct']}/{total['total']})", "ties": total["ties"]}
    sums: list[list] = [["指标", "值"], *([label, values[k]] for k, label in SUMMARY_LABELS.items()), [""], list(PER_N_HEAD)]
    sums += [[PER_N_LABEL.format(r["n_senses"]), r["correct"], r["total"], f"{r['accuracy']:.1%}"] for r in wsd.per_n(details).orderBy("n_senses").collect()]
    parts = {r["status"]: r for r in wsd.ablation(details).collect()}
    split: list[list] = [[NO_ABLATION]]
    if parts:
        rate = wsd.match_rate(details).first()[0]
        split = [[ABLATION_HEADS[0]], [ABLATION_RATE, f"{rate:.1%}"], [], [ABLATION_HEADS[1]], list(ABLATION_COLUMNS)]
        split += [[label, parts[k]["total"], parts[k]["correct"], f"{parts[k]['accuracy']:.1%}", note] for k, (label, note) in ABLATION_ROWS.items() if k in parts]
    return workbook({DETAIL_SHEET: detail_lines(details), SUMMARY_SHEET: sums, ABLATION_SHEET: split})


def plain(number: object) -> object:
    """A sense number as a number where it is one."""
    return int(number) if isinstance(number, str) and re.fullmatch(r"-?\d{1,15}", number) else number


def genre_line(rows: DataFrame) -> str:
    """How many essays (genre) there are of each genre, in the order of the reports."""
    found = {r["genre"]: r["count"] for r in rows.groupBy("genre").count().collect()}
    return CONSOLE["genres"].format({GENRE_NAMES[x]: found[x] for x in (LETTER, ESSAY, NARRATIVE, REPORT) if x in found})


def evaluation_console(details: DataFrame, encoder: str, strategy: str, log: DataFrame | None = None) -> str:
    """Accuracy, and with a ``match_log`` how many sentences each method matched."""
    total = wsd.summary(details).first()
    values = {"encoder": [encoder], "strategy": [strategy], "accuracy": [total["accuracy"], total["correct"], total["total"]], "ties": [total["ties"]], "per_n": []}
    lines = [CONSOLE[k].format(*v) for k, v in values.items()]
    lines += [CONSOLE["n"].format(r["n_senses"], r["accuracy"], r["correct"], r["total"]) for r in wsd.per_n(details).orderBy("n_senses").collect()]
    parts = {r["status"]: r for r in wsd.ablation(details).collect()}
    if parts:
        lines.append(CONSOLE["rate"].format(wsd.match_rate(details).first()[0]))
        lines += [CONSOLE[k].format(parts[k]["accuracy"], parts[k]["correct"], parts[k]["total"]) for k in ABLATION_ROWS if k in parts]
        if log is not None:
            lines.append(CONSOLE["methods"].format("  ".join(CONSOLE["method"].format(*r) for r in wsd.by_method(wsd.match_stats(log)).collect())))
    return "\n".join(lines)
