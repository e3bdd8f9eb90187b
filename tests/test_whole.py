"""Queries over whole texts and all rows."""

import inspect
import json
import re

from scoreloom.functions import parsing
from scoreloom.operators import stats
from scoreloom.plans import catalog
from scoreloom.sources import adapters

SF = "/root/testdata/sf0.001"


def test_whole_answers(spark):
    """Against a plain parser over the untouched turns."""

    def token(raw):
        if not isinstance(raw, str):
            return None
        t = re.sub(r"[\s.!?؛。,…]+$", "", raw.strip().strip(parsing.QUOTES)).strip()
        if t.upper() in ("A", "B", "C", "D", "E", "DECLINED"):
            return t.upper(), "declined_explicit" if t.upper() == "DECLINED" else None
        return None

    def load(text):
        try:
            got = json.loads(text)
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}

    def parse(text):
        if not text.strip():
            return None, None, "empty_response"
        lines = re.findall(r"(?im)^\s*(?:final\s*answer|antwort)\s*[:：\-–—]?\s*([^\n]+?)\s*$", text)
        if lines and (t := token(lines[-1])):
            return t[0], None, t[1]
        whole, block = load(text), re.search(r"\{[\s\S]*?\}", text)
        if t := token(whole.get("answer")):
            return t[0], whole.get("reason"), t[1]
        part = load(block[0]) if block else {}
        if t := token(part.get("answer")):
            return t[0], part.get("reason"), t[1] or "json_extracted"
        if re.search("|".join(parsing.DECLINE_PHRASES), text, re.I):
            return "DECLINED", None, "declined_phrase"
        if m := re.search(r"\b([A-Ea-e])\b", text):
            return m[1].upper(), None, "regex_fallback"
        return None, None, "no_parse"

    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").collect()
    want = {f"{r.conv_id}-{r.turn}": parse((r.text or "") + "\n" + adapters.TAILS[r.conv_id % 8]) for r in turns}
    want |= {f"{r.conv_id}-{r.turn}-tail": parse(adapters.TAILS[r.conv_id % 8]) for r in turns}
    got = {r.id: (r.answer, r.rationale, r.warning) for r in catalog.QUERIES["F01_F05_parse_answers"](spark, SF).collect()}
    assert got == want
    texts = {r.id: r.text for r in adapters.responses(spark, SF).collect()}
    assert all(texts[f"{r.conv_id}-{r.turn}"].startswith(r.text or "") for r in turns)


def test_null_last_order(spark):
    """All rows of each run: those with a value (even years) first, then the null ones by year and group."""
    rows = catalog.QUERIES["O12_null_last_sort_whole"](spark, SF).collect()
    scored = adapters.results(spark, SF).where("group is not null").select("run_id", "year", "group").distinct().collect()
    assert {(r.run_id, r.year, r.group) for r in rows} == {tuple(r) for r in scored} and len(rows) == len(scored)
    for run in {r.run_id for r in rows}:
        own = sorted((r for r in rows if r.run_id == run), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        null = [(r.year, r.group) for r in own if r.year % 2]
        assert null and null == sorted(null) and [r.year % 2 for r in own] == sorted(r.year % 2 for r in own)


def test_bootstrap_resamples(spark, monkeypatch):
    seen, plain = [], stats.bootstrap

    def spy(*args, **kwargs):
        call = inspect.signature(plain).bind(*args, **kwargs)
        call.apply_defaults()
        seen.append(call.arguments["times"])
        return plain(*args, **kwargs)

    monkeypatch.setattr(stats, "bootstrap", spy)
    catalog.QUERIES["N15_N20_alignment"](spark, SF)
    assert seen == [2000] and inspect.signature(stats.bootstrap_fit).parameters["times"].default == 2000


def test_facets_scan_once(spark):
    """All attributes come from one scan of the rows."""
    from scoreloom.operators import dashboard

    rows = spark.createDataFrame([(2000, "a", "en", None, "A", ["w", "w"]), (2001, None, "en", "x", "", None)], "year int, `group` string, language string, reasoning_mode string, predicted string, warnings array<string>")
    found = dashboard.facets(rows)
    assert {r.attribute: r["values"] for r in found.collect()} == {"year": ["2000", "2001"], "group": ["a"], "language": ["en"], "reasoning_mode": ["x"], "predicted": ["", "A"], "warnings": ["w"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan
