"""Plans as graphs: nodes and edges of a DataFrame's plan, in DOT and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class PlanGraph:
    """Operators of a plan by number, and edges from a parent to its children."""

    nodes: list[tuple[str, str]] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"nodes": [{"id": i, "operator": n, "detail": d} for i, (n, d) in enumerate(self.nodes)], "edges": [{"from": a, "to": b} for a, b in self.edges]})

    def to_dot(self) -> str:
        lines = [f'  n{i} [label="{n}"];' for i, (n, _) in enumerate(self.nodes)] + [f"  n{a} -> n{b};" for a, b in self.edges]
        return "digraph plan {\n" + "\n".join(lines) + "\n}\n"


def plan_graph(frame: DataFrame, kind: str = "optimizedPlan") -> PlanGraph:
    """``kind``: analyzed, optimizedPlan, sparkPlan or executedPlan."""
    graph = PlanGraph()

    def add(node) -> int:
        me = len(graph.nodes)
        graph.nodes.append((node.nodeName(), node.simpleString(200)))
        children = node.children()
        for i in range(children.size()):
            child = add(children.apply(i))
            graph.edges.append((me, child))
        return me

    add(getattr(frame._jdf.queryExecution(), kind)())
    return graph
