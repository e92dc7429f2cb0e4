"""Evidence for answers: parts reduced to distinct rows in order, deterministic facts, contexts, and the staged pipeline.

Row sets are DataFrames of any size; the pipeline works on the bounded evidence of one question and calls the
model clients it is given. A client's failure pauses the run with what is known so far.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T

PART_KEY = ("work_order_id", "name", "code", "quantity")
#: fixed values: levels of relevance and other words for them; stages in order
LEVELS = {"high": "high", "medium": "medium", "low": "low", "unrelated": "unrelated", "unknown": "unknown", "相关": "high", "高度相关": "high", "中等相关": "medium", "可能相关": "medium", "不相关": "unrelated", "无关": "unrelated"}
STAGES = ("retrieval", "work_order_filter", "manual_filter", "fact_extraction", "answer")
FILTER_THREADS, FILTER_THREADS_MOST = 8, 16
SUMMARY = 260


def answer_parts(parts: DataFrame) -> DataFrame:
    """Normal part rows: name, code, quantity, work_order_id, each from the first of its sources that isn't empty. Other columns stay."""
    has = lambda *cs: [F.col(c) for c in cs if c in parts.columns]
    first = lambda *cs: F.coalesce(T.first_non_empty(*has(*cs)), F.lit("")) if has(*cs) else F.lit("")
    return parts.select(
        *(F.col(c) for c in parts.columns if c not in ("name", "code", "quantity", "work_order_id")),
        first("name", "part_name", "part_number_name").alias("name"), first("code", "part_code", "part_number").alias("code"),
        first("quantity").alias("quantity"), first("source_work_order_id", "work_order_id").alias("work_order_id"),
    )


def _first_rows(rows: DataFrame, keys: tuple[str, ...], group: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key: one aggregation with combining in each task, so a hot key isn't gathered."""
    rest = [c for c in rows.columns if c not in (*keys, *group)]
    return rows.groupBy(*group, *keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*group, *keys, "_x.*")


def distinct_parts(parts: DataFrame, order: tuple[str, ...], group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Parts once for each (order, name, code, quantity), the first in order; rows with none of them left out."""
    p = answer_parts(parts).where(F.greatest(*(F.col(k) != "" for k in PART_KEY)))
    return _first_rows(p, PART_KEY, group, order)


def coded_parts(parts: DataFrame, order: tuple[str, ...], group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return distinct_parts(parts, order, group).where(F.col("code") != "")


def merge_coded(primary: DataFrame, secondary: DataFrame, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Coded parts of both, those of the first winning; both need a `position`."""
    both = primary.withColumn("_side", F.lit(0)).unionByName(secondary.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return coded_parts(both, ("_side", "position"), group).drop("_side")


def relevance(x: Column) -> Column:
    m = F.create_map(*(F.lit(v) for kv in LEVELS.items() for v in kv))
    return F.coalesce(m[F.lower(T.clean_string(x))], F.lit("unknown"))


def accepted(judged: DataFrame) -> DataFrame:
    """Judged orders (level, related) that count: high or medium, unless said to be unrelated."""
    return judged.where(relevance(F.col("level")).isin("high", "medium") & F.coalesce(F.col("related"), F.lit(True)))


# --- one question, bounded evidence -------------------------------------------------------------


def clean(x: object) -> str:
    return "" if x is None else str(x).strip()


def items(x: object) -> list[dict]:
    return [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []


def strings(x: object) -> list[str]:
    return [s for s in map(clean, x) if s] if isinstance(x, list) else [s] if (s := clean(x)) else []


def parse_object(reply: str) -> dict:
    """The JSON object of a reply, in a fence or between other words. Anything else is a ValueError."""
    bare = re.sub(r"\A```[A-Za-z]*\s*|\s*```\Z", "", reply.strip())
    for text in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
        try:
            if isinstance(got := json.loads(text), dict):
                return got
        except ValueError:
            continue
    raise ValueError("the reply holds no JSON object")


def level(x: object) -> str:
    return LEVELS.get(clean(x).lower(), "unknown")


def part(p: Mapping) -> dict:
    first = lambda *ks: next((v for k in ks if (v := clean(p.get(k)))), "")
    return {"name": first("name", "part_name", "part_number_name"), "code": first("code", "part_code", "part_number"), "quantity": first("quantity"), "work_order_id": first("source_work_order_id", "work_order_id")}


def unique(parts: list[dict], coded: bool = False) -> list[dict]:
    seen: dict[tuple, dict] = {}
    for p in map(part, parts):
        if any(p.values()) and (p["code"] or not coded):
            seen.setdefault(tuple(p.values()), p)
    return list(seen.values())


class ProviderError(RuntimeError):
    """A model client couldn't answer."""


class Paused(RuntimeError):
    """The run stopped before its end; `snapshot` holds what it had."""

    def __init__(self, stage: str, reason: str, snapshot: dict) -> None:
        super().__init__(f"{stage}: {reason}")
        self.stage, self.reason, self.snapshot = stage, reason, snapshot


#: a client takes a task name and its payload and returns the model's text
Client = Callable[[str, dict], str]


@dataclass
class Pipeline:
    """Retrieval result of one question to an answer. Without a client evidence is accepted as it is, and the answer is
    paused, unless a deterministic one is asked for. Reranking is off unless a reranker is given."""

    client: Client | None = None
    progress: Callable[[str, dict], None] | None = None
    deterministic_answer: bool = False
    threads: int = FILTER_THREADS
    rerank: Callable[[str, list[dict]], list[float]] | None = None
    top_n: int | None = None
    trace: list[dict] = field(default_factory=list)

    def _done(self, stage: str, state: dict, **more: object) -> None:
        self.trace.append({"stage": stage, **more})
        if self.progress:
            self.progress(stage, state)

    def judge(self, query: str, hit: dict, parts: list[dict]) -> dict:
        own = [p for p in parts if clean(p.get("work_order_id")) == clean(hit.get("work_order_id")) != ""]
        out = {"work_order_id": clean(hit.get("work_order_id")), "hit": hit, "related": False, "level": "unknown", "reason": "", "actions": [], "parts": []}
        if self.client is None:
            return out | {"related": True, "level": "medium", "reason": "filter off", "parts": unique(own)}
        try:
            got = parse_object(self.client("work_order_filter", {"query": query, "hit": hit, "parts": own}))
        except ValueError:
            return out | {"reason": "the reply isn't JSON"}
        grade = level(got.get("relevance_level"))
        related = grade in ("high", "medium") and got.get("related") is not False
        return out | {"level": grade, "related": related, "reason": clean(got.get("matched_reason")), "actions": strings(got.get("repair_actions")), "parts": unique(items(got.get("usable_parts"))) or (unique(own) if related else [])}

    def run(self, query: str, package: dict) -> dict:
        """package: work_orders, manuals, fault_codes and parts, each a list of hits in rank order."""
        state: dict = {"query": query, "package": package}
        orders, manuals, parts = (items(package.get(k)) for k in ("work_orders", "manuals", "parts"))
        how = {}
        if self.rerank and orders:
            try:
                orders = reordered(orders, self.rerank(query, orders), self.top_n)
            except Exception as e:  # noqa: BLE001  a reranker may fail in any way; the found order stands
                how = {"rerank": "fallback", "reason": f"{type(e).__name__}: {e}"[:300]}
        self._done("retrieval", state, hits=len(orders), **how)
        stage = "work_order_filter"
        try:
            with ThreadPoolExecutor(max(1, min(self.threads, FILTER_THREADS_MOST, len(orders) or 1))) as pool:
                judged = list(pool.map(lambda h: self.judge(query, h, parts), orders))
            state["orders"] = [j for j in judged if j["related"]]
            state["rejected_orders"] = [j for j in judged if not j["related"]]
            self._done(stage, state, accepted=len(state["orders"]), status="skipped" if not orders else "ok")
            stage = "manual_filter"
            state["manuals"], state["rejected_manuals"], how = self._manuals(query, manuals)
            self._done(stage, state, accepted=len(state["manuals"]), rejected=len(state["rejected_manuals"]), **how)
            stage = "fact_extraction"
            state["facts"] = self._facts(query, state, items(package.get("fault_codes")), parts)
            self._done(stage, state)
            stage = "answer"
            state["context"] = self._context(query, state, items(package.get("fault_codes")))
            if self.client is None and not self.deterministic_answer:
                self._done(stage, state, status="llm_disabled")
                raise Paused(stage, "llm_disabled", state)
            state["answer"] = render(state) if self.client is None else clean(self.client("answer", state["context"]))
            if not state["answer"]:
                raise Paused(stage, "empty answer", state)
            self._done(stage, state, status="ok")
        except ProviderError as e:
            self.trace.append({"stage": stage, "status": "paused", "reason": str(e)})
            raise Paused(stage, str(e), state) from e
        return state | {"trace": self.trace}

    def _manuals(self, query: str, manuals: list[dict]) -> tuple[list[dict], list[dict], dict]:
        """Manuals that the model takes, those it doesn't with the reason, and how it went. A reply that can't be read takes all of them, as medium."""
        if self.client is None or not manuals:
            return manuals, [], {"status": "skipped"}
        try:
            got = parse_object(self.client("manual_filter", {"query": query, "titles": [{"doc_id": m.get("doc_id"), "title": m.get("title")} for m in manuals]}))
        except ValueError as e:
            kept = [m | {"level": "medium", "reason": "the filter failed; kept as found"} for m in manuals]
            return kept, [], {"status": "fallback", "reason": "manual_filter_failed", "error": f"{type(e).__name__}: {e}"}
        verdicts: dict[str, tuple[str, str]] = {}
        for x in items(got.get("selected")):
            grade = level(x.get("relevance_level") or "medium")
            verdicts.setdefault(clean(x.get("doc_id")), (grade if grade in ("high", "medium") else "unrelated", clean(x.get("reason")) or ("taken by the model" if grade in ("high", "medium") else "not graded as relevant")))
        for x in items(got.get("rejected")):
            verdicts.setdefault(clean(x.get("doc_id")), ("unrelated", clean(x.get("reason")) or "rejected by the model"))
        judged = [m | dict(zip(("level", "reason"), verdicts.get(clean(m.get("doc_id")), ("unrelated", "not named by the model")), strict=True)) for m in manuals]
        return [m for m in judged if m["level"] != "unrelated"], [m for m in judged if m["level"] == "unrelated"], {"status": "ok"}

    def _facts(self, query: str, state: dict, codes: list[dict], parts: list[dict]) -> dict:
        ids = {j["work_order_id"] for j in state["orders"]}
        chosen = [p for j in state["orders"] for p in j["parts"]] + [p for p in parts if clean(p.get("work_order_id")) in ids - {""}]
        brief = lambda h: {"doc_id": h.get("doc_id"), "title": h.get("title"), "summary": clean(h.get("body_preview"))[:SUMMARY]}
        facts = {
            "fault_code_facts": [brief(h) for h in codes],
            "work_order_groups": [{"summary": j["reason"] or "; ".join(j["actions"]), "repair_actions": j["actions"], "source_work_orders": [j["work_order_id"]], "parts": j["parts"]} for j in state["orders"]],
            "manual_summaries": [brief(m) for m in state["manuals"]],
            "coded_parts": unique(chosen, coded=True),
            "uncoded_possible_parts": [],
        }
        if self.client is None:
            return facts
        try:
            got = parse_object(self.client("fact_extraction", {"query": query, "facts": facts}))
        except ValueError:
            return facts
        better = {k: items(got.get(k)) or v for k, v in facts.items()}
        return better | {"coded_parts": unique(facts["coded_parts"] + items(got.get("coded_parts")), coded=True), "uncoded_possible_parts": items(got.get("uncoded_possible_parts"))}

    @staticmethod
    def _context(query: str, state: dict, codes: list[dict]) -> dict:
        evidence = [h | {"channel": "manual_fault_codes"} for h in codes]
        evidence += [j["hit"] | {"channel": "work_orders", "filter": {"level": j["level"], "reason": j["reason"], "actions": j["actions"]}} for j in state["orders"]]
        evidence += [m | {"channel": "manual_typical_faults"} for m in state["manuals"]]
        return {"query": query, "facts": state["facts"], "evidence": evidence}


def reordered(hits: list[dict], scores: list[float], top_n: int | None = None) -> list[dict]:
    """Hits by the reranker's scores from the best down, equal ones as they were, at most top_n."""
    order = sorted(range(len(hits)), key=lambda i: (-scores[i], i))[: top_n if top_n is None else max(top_n, 0)]
    return [hits[i] | {"rerank_score": scores[i]} for i in order]


def rerank_text(hit: dict, chars: int) -> str:
    """What a reranker reads of a hit: its named facts, a line each, then the preview."""
    named = (f"{k}: {v}" for k in ("channel", "title", "doc_type", "work_order_id", "source_path") if (v := clean(hit.get(k))))
    return "\n".join([*named, *filter(None, [clean(hit.get("body_preview"))])])[:chars]


#: fixed values: headings and sentences of the answer that is made of found evidence alone
PLAIN_ANSWER = {"question": "问题：", "causes": "可能故障原因：", "no_causes": "- 未从手册证据中召回明确故障标题。", "advice": "处理建议：", "parts": "备件候选：", "no_parts": "- 未召回明确备件候选。", "note": "注意：以上备件来自历史工单或手册证据，未经过当前设备适配校验。"}


def render_plain(query: str, evidence: list[dict], parts: list[dict]) -> str:
    """An answer from flattened evidence alone: titles of five manuals, previews of the first five hits, every linked part."""
    a = PLAIN_ANSWER
    titles = [clean(e.get("title")) for e in evidence if e.get("doc_type") == "manual_typical_fault" and e.get("title")][:5]
    seen = [f"- 参考 {e.get('doc_id')}: {clean(e.get('body_preview'))[:180]}" for e in evidence[:5] if e.get("body_preview")]
    of = lambda p, none, *ks: next((v for k in ks if (v := clean(p.get(k)))), none)
    listed = [f"- 名称={of(p, '未知', 'part_name', 'part_number_name')}, 编码={of(p, '未提供', 'part_code')}, 数量={of(p, '未提供', 'quantity')}, 来源工单={of(p, '未知', 'work_order_id')}" for p in parts]
    blocks = [[a["question"] + query], [a["causes"], *([f"- {t}" for t in titles] or [a["no_causes"]])], [a["advice"], *seen], [a["parts"], *(listed or [a["no_parts"]])], [a["note"]]]
    return "\n\n".join("\n".join(b) for b in blocks)


def render(state: dict) -> str:
    """An answer from facts alone, in fixed sections."""
    f = state["facts"]
    listed = lambda rows, fmt: "\n".join(f"- {fmt(r)}" for r in rows) or "- 无"
    return "\n\n".join((
        "## 故障码\n" + listed(f["fault_code_facts"], lambda r: f"{r.get('title')}: {r.get('summary')}"),
        "## 相似工单\n" + listed(f["work_order_groups"], lambda r: f"{', '.join(map(clean, r.get('source_work_orders', [])))}: {r.get('summary')}"),
        "## 手册\n" + listed(f["manual_summaries"], lambda r: f"{r.get('title')}: {r.get('summary')}"),
        "## 备件\n" + listed(f["coded_parts"], lambda r: f"{r['name']} {r['code']} x {r['quantity'] or '?'} ({r['work_order_id']})"),
    ))
