import json

from loomspark import service
from loomspark.plans.knowledge import Perspective
from loomspark.plans.projection import Graph
from loomspark.streaming import watch


def test_a_project_is_written_and_asked(spark, tmp_path, capsys):
    g = Graph(spark, "/root/testdata/sf0.001")
    engine = service.Engine(spark, f"file://{tmp_path}")
    engine.create("p", {"nodes": g.nodes, "edges": g.edges, "marks": g.marks}, "first")
    assert engine.stats("p").where("part = 'node' AND key = 'Table'").first().n == 200
    assert engine.nodes("p", "Table", limit=3).count() == 3 and engine.projects(["p"]).first().description == "first"
    assert {r.rule_id for r in engine.check("p", {"dead-table"}).collect()} == {"dead-table"}
    assert engine.candidates("p", "Table").first().value >= 0 and engine.recall("p", "where is order_1?").count() == 10
    engine.create("p", {"nodes": g.nodes.where("kind = 'Table'"), "edges": g.edges.where("false"), "marks": g.marks.where("false")}, "second")
    assert engine.stats("p").count() < 30 and engine.neighbors("p", 1).count() == 0
    assert service.main(["nodes", "p", "Table", "--root", f"file://{tmp_path}"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["kind"] == "Table"


def test_states_settings_and_views(spark, tmp_path):
    g, heard = Graph(spark, "/root/testdata/sf0.001"), []
    engine = service.Engine(spark, f"file://{tmp_path}", lambda *x: heard.append(x[:2]))
    engine.create("p", {"nodes": g.nodes, "edges": g.edges, "marks": g.marks})
    assert heard == [("p", "written")] and engine.violations("p").count() == 0 and engine.settings("p") == {}
    assert engine.run_check("p", {"dead-table"}).first().rule_id == "dead-table"
    before = engine.violations("p", 10**6).count()
    engine.run_check("p", {"hot-table"})  # the other rule's violations stay
    assert engine.violations("p", 10**6).where("rule_id = 'dead-table'").count() == before
    engine.configure("p", {"dead-table": {"enabled": False}, "hot-table": {"enabled": True}})
    engine.configure("p", {"hot-table": None})
    assert engine.settings("p") == {"dead-table": {"enabled": False}}
    assert engine.run_check("p").where("rule_id = 'dead-table'").count() == 0
    engine.put_state("p", "diagnostics", spark.createDataFrame([(1, "a.b", "error", "m", None), (2, "a.c", "warning", "m", 1)], service.STATES["diagnostics"]))
    assert engine.diagnostics("p").first().id == 2 and engine.diagnostics_summary("p")[0].count() == 2
    engine.describe("p", "named")
    engine.vacuum("p")
    assert engine.projects(["p"]).first().description == "named" and engine.diagnostics("p").count() == 2
    table = g.nodes.where("kind = 'Table'").orderBy("id").first()
    assert engine.node("p", table.id).first().name == table.name and engine.rules().count() == len(service.RULES)
    assert engine.annotations("p", table.id).count() == g.marks.where(f"node_id = {table.id}").count() and engine.locations("p", table.id).count() == 0
    view = Perspective("t", "Table", direction="reverse", depth=1)
    assert engine.perspectives("p", {"t": view}).first().n == 200
    assert engine.view("p", view, table.id).where("ring = 0").first().name == table.name
    assert engine.coverage("p")[0].agg({"total": "sum"}).first()[0] == g.nodes.where("kind = 'CallSite'").count()
    assert engine.sub_projects("p").agg({"n": "sum"}).first()[0] == g.nodes.count() and engine.kinds("p").where("part = 'node' and kind = 'Table'").count() == 1
    asked = engine.prompt("p", "where is order_1?")
    assert asked["text"].startswith("# where is order_1?") and asked["tokens"] > 10 and engine.warm_up("p").first().kind in ("HttpContract", "Table")
    engine.delete("p")
    assert not (tmp_path / "p").exists()


def test_rebuilds_keep_their_distance():
    now, waits, runs = [0.0], [], []
    run = watch.cooled(lambda batch, number: runs.append((number, now[0])), 30.0, lambda: now[0], lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    run(None, 0)
    now[0] = 10.0
    run(None, 1)
    now[0] = 100.0
    run(None, 2)
    assert runs == [(0, 0.0), (1, 30.0), (2, 100.0)] and waits == [20.0, 0.0]
