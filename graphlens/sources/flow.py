"""Control flow and property graph of Python sources.

``flow_of`` makes basic blocks and typed control edges of a function; ``graph_rows`` nodes and
edges of a file: functions, parameters, assignments, references, calls and blocks, with data
flow inside the file. Files are independent rows; calls between files are joins (``linked``).
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.graph import python_rows

NODE = "node_id string, node_type string, name string, file string, line int, end_line int, function string, source string, position int, src string, dst string, edge_type string, kind string"
FIELDS = [(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in NODE.split(", ")]


class Flow:
    """Basic blocks [kind, first line, last line] and edges (from, to, kind) of one function."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef):
        end = function.end_lineno or function.lineno
        self.blocks, self.edges = [["entry", function.lineno, function.lineno], ["exit", end, end]], []
        self.loops: list[tuple[int, list]] = []
        self.join(self.sequence(function.body, [(0, "fallthrough")]), 1)

    def block(self, kind: str, line: int, end: int) -> int:
        self.blocks.append([kind, line, end])
        return len(self.blocks) - 1

    def join(self, live: list, to: int) -> None:
        for at, kind in live:
            if (at, to, kind) not in self.edges:
                self.edges.append((at, to, kind))

    def sequence(self, body: list[ast.stmt], live: list) -> list:
        """Appends statements to the ends ``live``; gives the ends that are open after them."""
        plain = None
        for s in body:
            end = s.end_lineno or s.lineno
            if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match, ast.With, ast.AsyncWith)):
                plain, live = None, self.control(s, live)
                continue
            if not live:
                break  # nothing reaches what follows a jump
            if plain is None:
                plain = self.block("basic", s.lineno, end)
                self.join(live, plain)
                live = [(plain, "fallthrough")]
            self.blocks[plain][2] = end
            if isinstance(s, (ast.Return, ast.Raise)):
                self.join([(plain, "return" if isinstance(s, ast.Return) else "exception")], 1)
                live = []
            elif isinstance(s, ast.Break) and self.loops:
                self.loops[-1][1].append((plain, "break"))
                live = []
            elif isinstance(s, ast.Continue) and self.loops:
                self.join([(plain, "continue")], self.loops[-1][0])
                live = []
        return live

    def control(self, s: ast.stmt, live: list) -> list:
        if not live:
            return []
        if isinstance(s, (ast.With, ast.AsyncWith)):
            head = self.block("basic", s.lineno, s.lineno)
            self.join(live, head)
            return self.sequence(s.body, [(head, "fallthrough")])
        if isinstance(s, (ast.Try, ast.TryStar)):
            head = self.block("try", s.lineno, s.lineno)
            self.join(live, head)
            after = self.sequence(s.orelse, self.sequence(s.body, [(head, "fallthrough")]))
            for handler in s.handlers:
                at = self.block("except", handler.lineno, handler.lineno)
                self.join([(head, "exception")], at)
                after = after + self.sequence(handler.body, [(at, "fallthrough")])
            return self.sequence(s.finalbody, after) if s.finalbody else after
        if isinstance(s, ast.Match):
            head = self.block("switch", s.lineno, s.lineno)
            self.join(live, head)
            after = [x for case in s.cases for x in self.sequence(case.body, [(head, "case")])]
            whole = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in s.cases)
            return after if whole else [*after, (head, "branch_false")]
        if isinstance(s, ast.If):
            head = self.block("branch", s.lineno, s.test.end_lineno or s.lineno)
            self.join(live, head)
            return self.sequence(s.body, [(head, "branch_true")]) + (self.sequence(s.orelse, [(head, "branch_false")]) if s.orelse else [(head, "branch_false")])
        head = self.block("loop", s.lineno, s.lineno)
        self.join(live, head)
        self.loops.append((head, []))
        self.join([(at, "loop_back") for at, _ in self.sequence(s.body, [(head, "branch_true")])], head)
        broken = self.loops.pop()[1]
        forever = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
        done = [] if forever else [(head, "branch_false")]
        return (self.sequence(s.orelse, done) if s.orelse else done) + broken


def functions_of(tree: ast.AST, owner: str = ""):
    """(qualified name, node) of all functions."""
    for child in ast.iter_child_nodes(tree):
        inner = owner
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{owner}.{child.name}" if owner else child.name
            if not isinstance(child, ast.ClassDef):
                yield inner, child
        yield from functions_of(child, inner)


def own_nodes(function: ast.AST):
    """What stands in a function, without functions inside it."""
    for child in ast.iter_child_nodes(function):
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            yield child
            yield from own_nodes(child)


def graph_rows(path: str, content: str):
    """Rows of one file: nodes have an id, edges a src and a dst. A source that does not parse gives
    one node of type ``error``."""
    none = (None,) * 4
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as error:
        yield f"error:{path}", "error", type(error).__name__, path, 0, 0, "", str(error)[:200], None, *none
        return

    def node(kind, name, line, end, function, source="", position=None):
        return f"{kind}:{path}:{function}:{line}:{name}", kind, name, path, line, end, function, source, position, *none

    def edge(src, dst, kind, how):
        return (None,) * 9 + (src, dst, kind, how)

    known = {}
    for name, f in functions_of(tree):
        known.setdefault(name.rpartition(".")[2], f"function:{path}:{name}:{f.lineno}:{f.name}")
    for name, f in functions_of(tree):
        head = node("function", f.name, f.lineno, f.end_lineno or f.lineno, name, ast.unparse(f.args))
        yield head
        defs: dict[str, list] = {}
        arguments = f.args.posonlyargs + f.args.args + f.args.kwonlyargs
        for k, a in enumerate(arguments):
            row = node("parameter", a.arg, a.lineno, a.lineno, name, ast.unparse(a), k)
            yield row
            yield edge(head[0], row[0], "DATA_FLOW", "parameter")
            defs.setdefault(a.arg, []).append((a.lineno, row[0]))
        calls, refs, targets = [], [], []
        for n in own_nodes(f):
            line, end = getattr(n, "lineno", 0), getattr(n, "end_lineno", 0) or 0
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for x in ast.walk(t):
                        if isinstance(x, ast.Name):
                            row = node("assignment", x.id, line, end, name, ast.unparse(n)[:200])
                            yield row
                            defs.setdefault(x.id, []).append((line, row[0]))
                            targets.append((line, end, x.id, row[0]))
            elif isinstance(n, ast.Call):
                called = n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "")
                if called:
                    row = node("call_site", called, line, end, name, ast.unparse(n)[:200], len(n.args))
                    yield row
                    calls.append((line, end, called, row[0], n))
                    yield edge(head[0], row[0], "CALLS", "call_site")
                    if called in known:
                        yield edge(row[0], known[called], "CALLS", "resolved")
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                refs.append((line, n.id))
        for line, var in sorted(set(refs)):
            row = node("variable_ref", var, line, line, name, var)
            yield row
            for at, d in defs.get(var, ()):  # a use is linked with each definition on another line
                if at != line:
                    yield edge(d, row[0], "DATA_FLOW", "def_use")
            for first, last, to, t in targets:
                if first <= line <= last and to != var:
                    yield edge(row[0], t, "DATA_FLOW", "assigned")
            for first, last, _, c, call in calls:
                if first <= line <= last and any(isinstance(x, ast.Name) and x.id == var for x in ast.walk(call)):
                    yield edge(row[0], c, "DATA_FLOW", "argument")
        for first, last, _, c, _ in calls:
            for line, end, _, t in targets:
                if line <= first and last <= end:
                    yield edge(c, t, "DATA_FLOW", "result")
        flow = Flow(f)
        ids = [f"block:{path}:{name}:{f.lineno}:{k}" for k in range(len(flow.blocks))]
        for k, (kind, line, end) in enumerate(flow.blocks):
            yield ids[k], "basic_block", kind, path, line, end, name, "", k, *none
        for a, b, kind in flow.edges:
            yield edge(ids[a], ids[b], "CTRL_FLOW", kind)


def property_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges of Python sources (path, content), files not joined yet."""
    rows = python_rows(files, graph_rows, NODE, FIELDS)
    nodes = rows.where("node_id is not null").drop("src", "dst", "edge_type", "kind")
    return nodes, rows.where("src is not null").select("src", "dst", "edge_type", "kind").distinct()


def module_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target): the files that imports (path, module, name) mean.

    A dotted module is looked for from the importing file's folder upwards, a relative one from
    the folder that its dots name: candidates are made by rule and met by an equi-join.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    level = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = lambda k: F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(folder, "/")) - k)), "/")
    steps = F.when(level > 0, F.array(level - 1)).otherwise(F.sequence(F.lit(0), F.size(F.split(folder, "/"))))
    at = imports.withColumn("dotted", dotted).withColumn("up", F.explode(steps)).withColumn("base", up(F.col("up")))
    stem = F.concat_ws("/", F.nullif("base", F.lit("")), F.nullif("dotted", F.lit("")))
    inner = F.concat_ws("/", F.nullif(stem, F.lit("")), "name")
    ends = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")), F.concat(inner, F.lit(".py")), F.concat(inner, F.lit("/__init__.py")))
    tried = at.select("path", "module", "name", "up", F.posexplode(ends).alias("rule", "target"))
    met = tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    nearest = F.min(F.struct("up", "rule", "target")).alias("b")
    return met.groupBy("path", "module", "name").agg(nearest).select("path", "module", "name", "b.target")


def linked(nodes: DataFrame, edges: DataFrame, reachable: DataFrame) -> DataFrame:
    """Call edges between files: a call that its file does not resolve goes to the first function of
    that name in a file that it imports (path, target); arguments flow to parameters by place."""
    resolved = edges.where("kind = 'resolved'").select(F.col("src").alias("node_id"))
    calls = nodes.where("node_type = 'call_site'").join(resolved, "node_id", "left_anti")
    functions = nodes.where("node_type = 'function'").select(F.col("name"), F.col("file").alias("target"), F.col("node_id").alias("to"), F.col("function").alias("callee"))
    met = calls.join(reachable.select(F.col("path").alias("file"), "target").distinct(), "file").join(functions, ["name", "target"])
    best = met.groupBy("node_id").agg(F.min(F.struct("target", "to", "callee")).alias("b")).select("node_id", "b.*")
    across = best.select(F.col("node_id").alias("src"), F.col("to").alias("dst"), F.lit("CALLS").alias("edge_type"), F.lit("cross_file").alias("kind"))
    params = nodes.where("node_type = 'parameter'").select(F.col("file").alias("target"), F.col("function").alias("callee"), F.col("node_id").alias("p"))
    given = best.join(params, ["target", "callee"]).select(F.col("node_id").alias("src"), F.col("p").alias("dst"), F.lit("DATA_FLOW").alias("edge_type"), F.lit("cross_file").alias("kind"))
    return edges.unionByName(across).unionByName(given).distinct()
