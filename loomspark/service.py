"""Use cases as functions over a stored graph: one method for each question, each giving a DataFrame.

A project is a folder: versions of its graph (``nodes``, ``edges``, ``marks``) and of its states (violations, diagnostics,
settings of rules), and a small table that names them.  Writers put a new version beside the old one and name it last, so
a lost driver leaves the old version whole; ``vacuum`` removes what no name points to any more.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import graph, store, views
from .operators.kinds import CHAIN_EDGES
from .operators.staging import remove
from .plans import build, ranking, recall
from .plans.knowledge import Perspective
from .plans.rules import RULES, check_graph, listed, report, save

PARTS = ("nodes", "edges", "marks")
#: States of a project beside its graph, with their columns.
STATES = {"violations": "rule_id string, severity string, node_id long, message string", "diagnostics": "id long, code string, severity string, message string, sub long", "settings": "rule_id string, settings string"}


class Engine:
    """Projects below one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, progress: Callable[[str, str, float], None] = lambda project, step, seconds: None):
        """``progress`` hears of each step of a project when it ends, with its seconds."""
        self.spark, self.root, self.progress = spark, root.rstrip("/"), progress

    def create(self, project: str, parts: dict[str, DataFrame], description: str = "") -> None:
        """Write a new version of a project's graph; the version table is written last."""
        version = f"v{time.time_ns()}"
        began = time.monotonic()
        store.write_graph({name: parts[name] for name in PARTS}, f"{self.root}/{project}/{version}")
        self.progress(project, "written", time.monotonic() - began)
        schemas = json.dumps({name: parts[name].schema.jsonValue() for name in PARTS})  # a part without rows has no file
        self._name(project, version, description, schemas)

    def _name(self, project: str, version: str, description: str, schemas: str, state: str = "") -> None:
        row = [(f"{project}/{state}" if state else project, version, description, time.time_ns(), schemas)]
        self.spark.createDataFrame(row, "project string, version string, description string, created_at long, schemas string").coalesce(1).write.mode("append").parquet(f"{self.root}/{project}/versions")

    def build(self, project: str, folder: str, stack: build.Stack = build.Stack(), description: str = "") -> DataFrame:
        """Write a new version from the source tree below ``folder``; its statistics."""
        began = time.monotonic()
        parts = build.build(self.spark, folder, stack)
        self.progress(project, "built", time.monotonic() - began)
        self.create(project, parts, description)
        return self.stats(project)

    def describe(self, project: str, description: str) -> None:
        """A new description of the newest version."""
        own = self.projects([project]).first()
        self._name(project, own.version, description, own.schemas)

    def delete(self, project: str) -> None:
        remove(self.spark, f"{self.root}/{project}")

    def vacuum(self, project: str) -> None:
        """Remove all versions of the graph and of states but the newest; nothing may read them any more."""
        rows = self.spark.read.parquet(f"{self.root}/{project}/versions").orderBy("created_at").collect()
        live = {r.project: r.version for r in rows}
        for version in {r.version for r in rows} - set(live.values()):
            remove(self.spark, f"{self.root}/{project}/{version}")

    def put_state(self, project: str, name: str, rows: DataFrame) -> None:
        """Replace a state (see ``STATES``)."""
        version = f"{name}-{time.time_ns()}"
        columns = [c.split()[0] for c in STATES[name].split(", ")]
        rows.select(*columns).write.parquet(f"{self.root}/{project}/{version}")
        self._name(project, version, "", "", state=name)

    def state(self, project: str, name: str) -> DataFrame:
        """A state's newest rows; none before the first are put."""
        rows = self.spark.read.parquet(f"{self.root}/{project}/versions").where(F.col("project") == f"{project}/{name}")
        own = rows.orderBy(F.desc("created_at")).first()
        return self.spark.read.schema(STATES[name]).parquet(f"{self.root}/{project}/{own.version}") if own else self.spark.createDataFrame([], STATES[name])

    def projects(self, names: list[str]) -> DataFrame:
        """The newest version of each of the named projects."""
        rows = self.spark.read.parquet(*[f"{self.root}/{n}/versions" for n in names]).where(F.col("project").isin(*names))
        return rows.groupBy("project").agg(F.max_by(F.struct("version", "description", "created_at", "schemas"), "created_at").alias("x")).select("project", "x.*")

    def part(self, project: str, name: str) -> DataFrame:
        own = self.projects([project]).first()
        schema = StructType.fromJson(json.loads(own.schemas)[name])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{project}/{own.version}/{name}").select(*schema.names)

    def stats(self, project: str) -> DataFrame:
        return store.stats(*(self.part(project, p) for p in PARTS))

    def kinds(self, project: str) -> DataFrame:
        return store.kinds(*(self.part(project, p) for p in PARTS))

    def coverage(self, project: str, top: int = 25) -> tuple[DataFrame, DataFrame]:
        """Call sites that any annotation explains, by sub-project, and the most frequent others."""
        calls = self.part(project, "nodes").where("kind = 'CallSite'").select("id", "sub", F.col("name").alias("callee"))
        return store.coverage(calls, self.part(project, "marks").select(F.col("node_id").alias("id")), top)

    def sub_projects(self, project: str) -> DataFrame:
        """(sub, language, n): nodes of each sub-project by language; null stands for shared nodes."""
        return self.part(project, "nodes").groupBy("sub", "language").agg(F.count("*").alias("n"))

    def node(self, project: str, node: int) -> DataFrame:
        return store.get_nodes(self.part(project, "nodes"), self.spark.range(node, node + 1))

    def annotations(self, project: str, node: int) -> DataFrame:
        return self.part(project, "marks").where(F.col("node_id") == node)

    def locations(self, project: str, node: int) -> DataFrame:
        """(id, origin, place): where a node is declared and where call sites lead to it."""
        at = F.concat_ws(":", F.get_json_object("props", "$.path"), F.get_json_object("props", "$.line"))
        placed = self.part(project, "nodes").select("id", at.alias("place")).where("place <> ''")
        to = self.part(project, "edges").where(F.col("to_id") == node).select("from_id", F.col("to_id").alias("node")).distinct()
        met = to.join(placed, to.from_id == placed.id).select(F.col("node").alias("id"), "place")
        return views.node_locations(placed.where(F.col("id") == node), met, placed.where("false"))

    def perspectives(self, project: str, known: dict[str, Perspective]) -> DataFrame:
        return views.perspectives(self.part(project, "nodes"), known)

    def view(self, project: str, perspective: Perspective, centre: int) -> DataFrame:
        """The layers around a centre with names and kinds."""
        nodes, edges = self.part(project, "nodes"), self.part(project, "edges").where(F.col("kind").isin(*CHAIN_EDGES))
        found = views.discover(edges, nodes, self.spark.range(centre, centre + 1), perspective.depth, perspective.direction)
        return found.join(nodes.select(F.col("id").alias("node"), "name", F.col("kind").alias("node_kind")), "node")

    def rules(self) -> DataFrame:
        rows = [(r.id, r.severity, list(r.kinds), list(r.languages), r.enabled) for r in RULES]
        return self.spark.createDataFrame(rows, "rule_id string, severity string, kinds array<string>, languages array<string>, enabled boolean")

    def configure(self, project: str, settings: dict[str, dict | None]) -> None:
        """Settings of rules: given ones replace the rule's own, None resets it; other rules keep theirs."""
        kept = self.state(project, "settings").where(~F.col("rule_id").isin(*settings)) if settings else self.state(project, "settings")
        new = [(k, json.dumps(v)) for k, v in settings.items() if v is not None]
        self.put_state(project, "settings", kept.unionByName(self.spark.createDataFrame(new, STATES["settings"])))

    def settings(self, project: str) -> dict[str, dict]:
        """Settings by rule: at most one row a rule."""
        return {r.rule_id: json.loads(r.settings) for r in self.state(project, "settings").collect()}

    def run_check(self, project: str, only: set[str] | None = None) -> DataFrame:
        """Check with the stored settings and store what is found; rules outside ``only`` keep their violations."""
        found = check_graph(*(self.part(project, p) for p in PARTS), RULES, self.settings(project), only).select(*[c.split()[0] for c in STATES["violations"].split(", ")])
        self.put_state(project, "violations", save(self.state(project, "violations"), found, only))
        return self.check_summary(project)

    def violations(self, project: str, limit: int = 500) -> DataFrame:
        return listed(self.state(project, "violations"), self.part(project, "nodes"), limit)

    def check_summary(self, project: str) -> DataFrame:
        return report(self.state(project, "violations"))

    def diagnostics(self, project: str, limit: int = 500) -> DataFrame:
        return store.newest(self.state(project, "diagnostics"), limit)

    def diagnostics_summary(self, project: str) -> tuple[DataFrame, DataFrame]:
        return store.severities(self.state(project, "diagnostics"))

    def warm_up(self, project: str) -> DataFrame:
        return ranking.warm_up_order(self.part(project, "nodes").withColumn("text", F.concat_ws(" ", "name", "fqn")))

    def prompt(self, project: str, question: str, limit: int = 10) -> dict:
        """The context text of a question's best hits, and its rough number of tokens."""
        text = ranking.markdown(question, self.recall(project, question, limit).collect())
        return {"text": text, "tokens": ranking.prompt_tokens(text)}

    def nodes(self, project: str, kind: str | None = None, term: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return store.query_nodes(self.part(project, "nodes"), kind, term, limit, offset)

    def neighbors(self, project: str, node: int, direction: str = "both") -> DataFrame:
        return graph.neighbors(self.part(project, "edges"), self.spark.range(node, node + 1), direction)

    def subgraph(self, project: str, node: int, depth: int = 2) -> DataFrame:
        return graph.reach(self.part(project, "edges"), self.spark.range(node, node + 1), depth, "both")

    def candidates(self, project: str, kind: str, side: str | None = None, term: str | None = None) -> DataFrame:
        edges = self.part(project, "edges").where(F.col("kind").isin(*CHAIN_EDGES))
        return views.candidates(self.part(project, "nodes"), edges, kind, side, term)

    def check(self, project: str, only: set[str] | None = None, config: dict | None = None) -> DataFrame:
        return listed(check_graph(*(self.part(project, p) for p in PARTS), RULES, config, only), self.part(project, "nodes"))

    def report(self, project: str) -> DataFrame:
        return report(check_graph(*(self.part(project, p) for p in PARTS), RULES))

    def recall(self, project: str, question: str, limit: int = 10) -> DataFrame:
        terms = recall.terms_of(question)
        return recall.best_hits(recall.lexical(self.part(project, "nodes"), self.part(project, "edges"), terms), limit) if terms else self.part(project, "nodes").select("id", "name", "kind", F.lit(0.0).alias("score")).where("false")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Command line: ``COMMAND PROJECT [ARGUMENT] --root FOLDER``; rows as JSON lines.  The argument is a folder (build), a
    kind (nodes, candidates), a rule (check), a question (recall), a node's id (node, annotations, locations, neighbors,
    subgraph) or nothing."""
    plain = ("stats", "report", "kinds", "sub_projects", "run_check", "violations", "check_summary", "diagnostics")
    by_id = ("node", "annotations", "locations", "neighbors", "subgraph")
    parser = argparse.ArgumentParser(prog="loomspark")
    parser.add_argument("command", choices=("build", "nodes", "candidates", "check", "recall", *plain, *by_id))
    parser.add_argument("project")
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--root", required=True)
    args = parser.parse_args(argv)
    engine = Engine(spark or SparkSession.builder.getOrCreate(), args.root)
    if args.argument is None and args.command in ("build", "candidates", "recall", *by_id):
        parser.error(f"{args.command} needs an argument")
    given = {args.argument} if args.command == "check" else int(args.argument) if args.command in by_id else args.argument
    extra = () if args.argument is None or args.command in plain else (given,)
    for row in getattr(engine, args.command)(args.project, *extra).toLocalIterator():
        print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
