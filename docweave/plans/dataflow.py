"""Declarative wiring of sources, transforms and sinks.

A dataflow is a small DAG of named nodes.  Sources make DataFrames, transforms
map DataFrames (a split returns ``Split`` and downstream edges pick ``yes`` or
``no``), sinks consume them.  Building the dataflow only composes DataFrame
plans -- Catalyst sees the whole chain and fuses it into as few stages as the
edges allow; an edge with a grouping adds exactly one exchange.

Rules checked when built: at least one source and one sink, every transform
and sink has at least one input, inputs exist, no cycles, a stream name is
only used on a split, and the grouping is known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from docweave.operators.routing import GROUPINGS, merge, partition
from docweave.operators.split import Split


@dataclass(frozen=True)
class Edge:
    """Input of a node: upstream ``node``, optional ``stream`` (yes/no), grouping."""

    node: str
    stream: str | None = None
    grouping: str = "none"
    key: str | Sequence[str] | None = None
    n: int | None = None


@dataclass
class _Node:
    name: str
    kind: str  # source | transform | sink
    fn: Callable
    inputs: list[Edge] = field(default_factory=list)
    parallelism: int | None = None


def _edge(e) -> Edge:
    if isinstance(e, Edge):
        return e
    if isinstance(e, str):
        return Edge(e)
    return Edge(*e)


class Dataflow:
    def __init__(self) -> None:
        self._nodes: dict[str, _Node] = {}

    def _add(self, node: _Node) -> Dataflow:
        if node.name in self._nodes:
            raise ValueError(f"duplicate node name {node.name!r}")
        self._nodes[node.name] = node
        return self

    def source(self, name: str, fn: Callable[[SparkSession], DataFrame],
               parallelism: int | None = None) -> Dataflow:
        return self._add(_Node(name, "source", fn, [], parallelism))

    def transform(self, name: str, fn: Callable[[DataFrame], DataFrame | Split],
                  *inputs, parallelism: int | None = None) -> Dataflow:
        return self._add(_Node(name, "transform", fn, [_edge(e) for e in inputs], parallelism))

    def sink(self, name: str, fn: Callable[[DataFrame], object], *inputs,
             parallelism: int | None = None) -> Dataflow:
        return self._add(_Node(name, "sink", fn, [_edge(e) for e in inputs], parallelism))

    # -- checks ------------------------------------------------------------------
    def validate(self) -> list[str]:
        kinds = [n.kind for n in self._nodes.values()]
        if "source" not in kinds:
            raise ValueError("a dataflow needs at least one source")
        if "sink" not in kinds:
            raise ValueError("a dataflow needs at least one sink")
        for n in self._nodes.values():
            if n.kind != "source" and not n.inputs:
                raise ValueError(f"{n.kind} {n.name!r} has no input")
            for e in n.inputs:
                if e.node not in self._nodes:
                    raise ValueError(f"{n.name!r} reads unknown node {e.node!r}")
                if self._nodes[e.node].kind == "sink":
                    raise ValueError(f"{n.name!r} reads from sink {e.node!r}")
                if (e.grouping or "").strip().lower() not in GROUPINGS:
                    raise ValueError(f"unknown grouping {e.grouping!r} on {n.name!r}")
                if e.stream not in (None, "yes", "no"):
                    raise ValueError(f"unknown stream {e.stream!r} on {n.name!r}")
        return self._order()

    def _order(self) -> list[str]:
        order, state = [], {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise ValueError(f"cycle through {name!r}")
            if state.get(name) == 2:
                return
            state[name] = 1
            for e in self._nodes[name].inputs:
                visit(e.node)
            state[name] = 2
            order.append(name)

        for name in self._nodes:
            visit(name)
        return order

    # -- build / run --------------------------------------------------------------
    def _input(self, built: dict, e: Edge) -> DataFrame:
        out = built[e.node]
        if isinstance(out, Split):
            if e.stream is None:
                raise ValueError(f"{e.node!r} is a split: pick stream 'yes' or 'no'")
            out = out[e.stream]
        elif e.stream is not None:
            raise ValueError(f"{e.node!r} has no stream {e.stream!r}")
        return partition(out, e.grouping, e.n, e.key)

    def _shared(self) -> set[str]:
        """Transforms that more than one edge reads: computed once, or their sinks could differ."""
        readers: dict[str, int] = {}
        for n in self._nodes.values():
            for e in n.inputs:
                readers[e.node] = readers.get(e.node, 0) + 1
        return {name for name, n in readers.items() if n > 1 and self._nodes[name].kind == "transform"}

    def build(self, spark: SparkSession, given: dict[str, DataFrame] | None = None,
              kept: list[DataFrame] | None = None) -> dict[str, DataFrame | Split]:
        """Compose every node's DataFrame (sinks are not run).

        ``given`` replaces source nodes by ready DataFrames (used per
        micro-batch).  Given a list ``kept``, batch results of transforms with
        several readers are persisted and put there for the caller to release.
        """
        built: dict[str, DataFrame | Split] = {}
        shared = self._shared() if kept is not None else set()

        def spread(out: DataFrame, n: int | None) -> DataFrame:
            return out.repartition(n) if n else out

        def keep(out: DataFrame) -> DataFrame:
            if out.isStreaming:
                return out
            kept.append(out.persist())
            return out

        for name in self.validate():
            node = self._nodes[name]
            if node.kind == "source" and given and name in given:
                out = given[name]
            elif node.kind == "source":
                out = node.fn(spark)
            else:
                ins = [self._input(built, e) for e in node.inputs]
                df = ins[0] if len(ins) == 1 else merge(*ins)
                if node.kind == "sink":
                    built[name] = spread(df, node.parallelism)
                    continue
                out = node.fn(df)
            if isinstance(out, Split):
                out = Split(spread(out.yes, node.parallelism), spread(out.no, node.parallelism), out.routed)
                if name in shared:
                    out = Split(keep(out.yes), keep(out.no), out.routed)
            else:
                out = spread(out, node.parallelism)
                if name in shared:
                    out = keep(out)
            built[name] = out
        return built

    def explain(self, spark: SparkSession, mode: str = "formatted") -> None:
        """Print the physical plan each sink would run (after Catalyst fused the nodes)."""
        built = self.build(spark)
        for n in self._nodes.values():
            if n.kind == "sink":
                print(f"== sink {n.name} ==")
                built[n.name].explain(mode)

    def run(self, spark: SparkSession) -> dict[str, object]:
        """Build, then hand each sink its input; returns what each sink returned.

        A transform that several sinks depend on runs once, so that they all
        see the same random choices and remote answers.
        """
        kept: list[DataFrame] = []
        try:
            built = self.build(spark, kept=kept)
            return {n.name: n.fn(built[n.name]) for n in self._nodes.values() if n.kind == "sink"}
        finally:
            for df in kept:
                df.unpersist()

    def run_stream(self, spark: SparkSession, checkpoint: str, **trigger):
        """Run the whole dataflow as streaming queries, one per streaming source.

        Each source is read once per micro-batch: inside ``foreachBatch`` the
        batch is persisted, the DAG is built on it -- the other streaming
        sources being empty in that batch, as their rows come in batches of
        their own -- and every sink gets its input, called as
        ``sink(df, batch_id)``, or ``sink(df, batch_id, source)`` where there
        are several sources, so it can write idempotently.  ``trigger`` is
        passed to ``docweave.streaming.run_stream`` (``every=``,
        ``available_now=``...).  Returns the query, or with several sources the
        list of queries in the order of the sources.
        """
        from docweave.streaming.runner import run_stream

        self.validate()
        sources = [n for n in self._nodes.values() if n.kind == "source"]
        streams = {n.name: n.fn(spark) for n in sources}
        live = [name for name, df in streams.items() if df.isStreaming]
        if not live:
            raise ValueError("run_stream needs a streaming source")
        static = {k: v for k, v in streams.items() if k not in live}
        empty = {k: spark.createDataFrame([], streams[k].schema) for k in live}
        sinks = [n for n in self._nodes.values() if n.kind == "sink"]

        def start(src: str):
            def each(batch: DataFrame, batch_id: int) -> None:
                batch = batch.persist()
                kept: list[DataFrame] = []
                try:
                    built = self.build(spark, {**static, **empty, src: batch}, kept)
                    for n in sinks:
                        n.fn(built[n.name], batch_id, *([src] if len(live) > 1 else []))
                finally:
                    for df in (*kept, batch):
                        df.unpersist()

            place = checkpoint if len(live) == 1 else f"{checkpoint.rstrip('/')}/{src}"
            return run_stream(streams[src], each, place, **trigger)

        queries = [start(src) for src in live]
        return queries[0] if len(queries) == 1 else queries
