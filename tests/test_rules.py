"""A lender's own rules: each scope, declared reads, hot keys, nothing at all."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from ledgerbeam.operators.partitioning import cut
from ledgerbeam.operators.rules import BORROWER, FILE, ROW, Rule, own_issues
from ledgerbeam.plans.convert import checked_segments
from ledgerbeam.plans.queries import OWN_RULES, TEMPLATE, _sheets, dated_defaults
from ledgerbeam.specs.registry import field_specs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sheets(spark):
    return _sheets(spark, SF)


def shown(df):
    return sorted((r.submission_id, r.rule, r.ac_no, r.row_number, r.message) for r in df.collect())


def test_query_matches_its_sql_and_meets_every_rule(spark):
    assert compare(spark, SF, "own_rules").startswith("ok")
    found = {r.rule for r in entry.queries()["own_rules"](spark, "/root/testdata/sf0.01").select("rule").distinct().collect()}
    assert found == {"mandatory", *[r.name for r in OWN_RULES]}


def test_hot_keys_change_nothing(sheets):
    assert shown(own_issues(sheets, TEMPLATE, OWN_RULES, hot_rows=1)) == shown(own_issues(sheets, TEMPLATE, OWN_RULES))


def test_rules_together_find_what_each_finds_alone(sheets):
    alone = [row for r in OWN_RULES for row in shown(own_issues(sheets, TEMPLATE, [r]))]
    assert shown(own_issues(sheets, TEMPLATE, OWN_RULES)) == sorted(alone)


def test_only_declared_fields_are_read(spark, sheets):
    with pytest.raises(KeyError, match="does not declare"):
        own_issues(sheets, TEMPLATE, [replace(OWN_RULES[0], reads={"CR": ("accountNumber",)})])
    checked = cut(checked_segments(sheets, TEMPLATE), "checked")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = own_issues(checked, TEMPLATE, OWN_RULES[:2])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert scans and all("values:" in s and "record:" not in s and "issues:" not in s for s in scans)


@pytest.mark.parametrize("wrong", [{"scope": "day"}, {"reads": {}}, {"reads": {"CR": (), "AS": ()}}, {"totals": {"n": lambda read: F.count("*")}}, {"key": lambda read: F.lit(1)}, {"scope": BORROWER}, {"scope": FILE}])
def test_rules_that_cannot_be_are_refused(wrong):
    with pytest.raises(ValueError):
        replace(OWN_RULES[0], **wrong)


def test_blanks_and_nothing(spark, sheets):
    """A condition that is NULL holds; a group without rows of the rule has no finding; empty envelopes and no rules give none."""
    blank = Rule("blank", ROW, {"BS": ("cin",)}, lambda read: read("BS.cin") != "x", lambda read: F.lit("x"))
    none = Rule("none", BORROWER, {"GS": ()}, lambda read: read("n") == 0, lambda read: F.lit("x"), totals={"n": lambda read: F.count_if(read.rows("GS"))})
    few = Rule("few", BORROWER, {"AS": ()}, lambda read: read("n") < 99, lambda read: F.lit("x"), totals={"n": lambda read: F.count_if(read.rows("AS"))})
    assert {r.rule for r in own_issues(sheets, TEMPLATE, [blank, none, few]).collect()} == {"few"}
    assert own_issues(sheets, TEMPLATE, []) is None and own_issues(sheets.limit(0), TEMPLATE, OWN_RULES).count() == 0
    assert field_specs(spark, dated_defaults(TEMPLATE)).where("condition = 'rule'").count() == 1
