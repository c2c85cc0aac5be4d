"""Python source: symbols, structural duplicates, dependencies. Parsing is a batch kernel; joins and groups are declarative."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "file_id long, name string, kind string, line long, last_line long, signature string, doc string, calls array<string>, complexity long, body_hash string"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_DEFINITIONS = (ast.ClassDef, ast.AsyncFunctionDef, ast.FunctionDef)
_BRANCHES = (ast.If, ast.For, ast.While, ast.Try, ast.BoolOp, ast.IfExp, ast.ExceptHandler, ast.comprehension)


class _Renamed(ast.NodeTransformer):
    """Parameters and assigned names by order of appearance, docstrings dropped: equal structure gives equal text."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def _of(self, name: str) -> str:
        return self.names.setdefault(name, f"v{len(self.names)}")

    def visit_arg(self, node: ast.arg) -> ast.arg:
        return ast.arg(self._of(node.arg), None)

    def visit_Name(self, node: ast.Name) -> ast.Name:  # noqa: N802
        known = isinstance(node.ctx, ast.Store) or node.id in self.names
        return ast.Name(self._of(node.id) if known else node.id, node.ctx)


def _structure(node: ast.AST) -> str:
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    shape = _Renamed().visit(ast.Module([*([node.args] if hasattr(node, "args") else []), *body], []))
    return hashlib.md5(ast.dump(shape).encode()).hexdigest()


def symbols_of(file_id: int, source: str) -> list[tuple]:
    """Functions and classes of one file; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows = []

    def walk(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFINITIONS):
                name = f"{prefix}{child.name}"
                is_class = isinstance(child, ast.ClassDef)
                calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                signature = f"class {child.name}" if is_class else f"def {child.name}({ast.unparse(child.args)})"
                complexity = 1 + sum(isinstance(c, _BRANCHES) for c in ast.walk(child))
                rows.append((file_id, name, "class" if is_class else "function", child.lineno, child.end_lineno, signature, ast.get_docstring(child), calls, complexity, _structure(child) if not is_class else None))
                walk(child, name + ".")

    walk(tree, "")
    return rows


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of (file_id, text); texts without two structural lines aren't parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string())
        for batch in batches:
            rows = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in symbols_of(i, t)]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)

    likely = F.regexp_count("text", F.lit(r"(?m)^\s*(def|class|import|from|return|if|for|while)\b")) >= 2
    return files.where(likely).select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(run, _SCHEMA)


def dependencies(found: DataFrame) -> DataFrame:
    """(file_id, src, dst): a symbol calls another of its file, by last name."""
    calls = found.select("file_id", F.col("name").alias("src"), F.explode("calls").alias("called"))
    targets = found.select("file_id", F.col("name").alias("dst"), F.element_at(F.split("name", "[.]"), -1).alias("called"))
    return calls.join(targets, ["file_id", "called"]).where("src <> dst").select("file_id", "src", "dst").distinct()


def structural_duplicates(found: DataFrame) -> DataFrame:
    """(body_hash, copies, canonical) of functions of some substance that are equal but for names."""
    groups = found.where("kind = 'function' AND complexity >= 2").groupBy("body_hash").agg(F.count(F.lit(1)).alias("copies"), F.min(F.concat_ws(":", F.col("file_id").cast("string"), "name")).alias("canonical"))
    return groups.where("copies > 1")
