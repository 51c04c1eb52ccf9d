from __future__ import annotations

import pytest

from curvestat.plans.runner import Step, fingerprints, pending, plan, resume, run


def test_steps_run_in_order_and_stop_at_a_failure(spark, tmp_path):
    steps = [Step("a", lambda s, t: s.range(5)), Step("b", lambda s, t: t["a"].filter("id > 2"), ("a",))]
    assert plan(steps) == ["a <- sources", "b <- a"]
    assert run(spark, steps, str(tmp_path))["b"].count() == 2
    with pytest.raises(ValueError):
        plan([Step("b", lambda s, t: t["a"], ("a",))])
    with pytest.raises(ZeroDivisionError):
        run(spark, [Step("x", lambda s, t: 1 / 0), Step("y", lambda s, t: s.range(1))], str(tmp_path))
    assert not (tmp_path / "y").exists()


def test_a_changed_parameter_or_source_reruns_what_depends_on_it(spark, tmp_path):
    source, folder, ran = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(4).write.parquet(source)

    def step(name, inputs=(), sources=(), **params):
        def build(s, t, **p):
            ran.append(name)
            base = s.read.parquet(source) if sources else t[inputs[0]]
            return base.filter(f"id >= {p.get('least', 0)}")

        return Step(name, build, inputs, params, sources)

    steps = lambda least: [step("a", sources=(source,)), step("b", ("a",), least=least), step("c", ("b",)), step("d", ("a",))]
    assert pending(spark, steps(1), folder) == ["a", "b", "c", "d"] and not ran
    assert resume(spark, steps(1), folder)["c"].count() == 3 and ran == ["a", "b", "c", "d"]
    ran.clear()
    assert resume(spark, steps(1), folder)["c"].count() == 3 and not ran and pending(spark, steps(1), folder) == []
    assert pending(spark, steps(2), folder) == ["b", "c"] and resume(spark, steps(2), folder)["c"].count() == 2 and ran == ["b", "c"]
    ran.clear()
    spark.range(9, 10).write.mode("append").parquet(source)
    assert resume(spark, steps(2), folder)["c"].count() == 3 and ran == ["a", "b", "c", "d"]
    assert len(set(fingerprints(spark, steps(2)).values())) == 4


def test_a_failure_is_recorded_and_the_next_run_goes_on(spark, tmp_path):
    folder, ran = str(tmp_path), []
    first = Step("a", lambda s, t: ran.append("a") or s.range(3))
    with pytest.raises(ZeroDivisionError):
        resume(spark, [first, Step("b", lambda s, t: 1 / 0, ("a",)), Step("c", lambda s, t: t["b"], ("b",))], folder)
    (row,) = spark.read.json(f"{folder}/_failed").collect()
    assert row["step"] == "b" and row["error"].startswith("ZeroDivisionError")
    out = resume(spark, [first, Step("b", lambda s, t: t["a"], ("a",)), Step("c", lambda s, t: t["b"], ("b",))], folder)
    assert out["c"].count() == 3 and ran == ["a"]
