"""Extraction from Python by its own syntax trees."""

from __future__ import annotations

import ast
import re

from .languages import Definition
from .services import http_target

ROUTE_VERBS = frozenset("get post put patch delete head options".split())
CLIENT_VERBS = ROUTE_VERBS | {"request"}
BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.ExceptHandler, ast.match_case, ast.IfExp)
NESTING = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.ExceptHandler, ast.Match)


def _complexity(node: ast.AST) -> tuple[int, int, int]:
    """An `elif` is a branch at the depth of its `if`, within it."""
    total, weighted, deepest = 1, 0, 0
    todo = [(child, 0, False) for child in ast.iter_child_nodes(node)]
    while todo:
        n, depth, is_elif = todo.pop()
        if isinstance(n, BRANCHES):
            total, weighted = total + 1, weighted + 1 + depth
        inner = depth + 1 if isinstance(n, NESTING) and not is_elif else depth
        deepest = max(deepest, inner)
        chained = n.orelse if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset else []
        todo += [(child, inner, bool(chained) and child is chained[0]) for child in ast.iter_child_nodes(n)]
    return total, weighted, deepest


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _is(node: ast.AST, dotted: str) -> bool:
    return isinstance(node, (ast.Attribute, ast.Name)) and ast.unparse(node) == dotted


def _env(node: ast.AST) -> str | None:
    """The key of an environment read."""
    if isinstance(node, ast.Call) and node.args and (_is(node.func, "os.getenv") or _is(node.func, "os.environ.get")):
        return _text(node.args[0])
    if isinstance(node, ast.Subscript) and _is(node.value, "os.environ"):
        return _text(node.slice)
    return None


def _routes(decorator: ast.AST, handler: str | None) -> list[dict]:
    if not (isinstance(decorator, ast.Call) and isinstance(decorator.func, ast.Attribute) and decorator.args):
        return []
    path, verb = _text(decorator.args[0]), decorator.func.attr
    if not path:
        return []
    row = {"path": path, "handler_name": handler, "line": decorator.lineno - 1, "protocol": "http"}
    if verb.lower() in ROUTE_VERBS:
        return [{**row, "method": verb.upper(), "framework": "fastapi"}]
    if verb == "route":
        lists = [k.value.elts for k in decorator.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))]
        methods = [m.upper() for x in lists for m in map(_text, x) if m]
        return [{**row, "method": m, "framework": "flask"} for m in methods or ["GET"]]
    return []


def extract(text: str) -> dict:
    """definitions, calls (name, line, caller), imports, routes, service_calls, config_keys of a module; ValueError if it
    does not parse."""
    out: dict[str, list] = {k: [] for k in ("definitions", "calls", "imports", "routes", "service_calls", "config_keys")}
    try:
        tree = ast.parse(text)
    except (SyntaxError, RecursionError, MemoryError) as error:
        raise ValueError(str(error)) from None
    lines = text.split("\n")

    def visit(node: ast.AST, path: tuple[str, ...], seen: dict[str, int], decorators: frozenset) -> None:
        for child in ast.iter_child_nodes(node):
            inner_path, inner_seen = path, seen
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                for d in child.decorator_list:
                    out["routes"] += _routes(d, child.name)
                n = seen.get(child.name, 0)
                seen[child.name] = n + 1
                inner_path, inner_seen = (*path, f"{child.name}#{n}" if n else child.name), {}
                function = not isinstance(child, ast.ClassDef)
                loc = sum(1 for line in lines[child.lineno - 1 : child.end_lineno] if line.strip())
                d = Definition(child.name, "function" if function else "class", child.lineno - 1, child.end_lineno - 1, None, (), "definition", ".".join(inner_path), loc=loc)
                if function:
                    d.cyclomatic, d.cognitive, d.max_nesting = _complexity(child)
                out["definitions"].append(d)
                decorators = decorators | frozenset(id(x) for x in child.decorator_list)
            elif isinstance(child, ast.Import):
                out["imports"].append(child.names[0].name)
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append("." * child.level + (child.module or ""))
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out["calls"].append({"name": name, "line": child.lineno - 1, "caller": ".".join(path) or None})
                if isinstance(child.func, ast.Attribute) and child.args and id(child) not in decorators and child.func.attr.lower() in CLIENT_VERBS:
                    _client(child, path)
            key = _env(child)
            if key:
                out["config_keys"].append({"key": key, "source": "env", "line": child.lineno - 1})
            if inner_path is path:
                visit(child, inner_path, inner_seen, decorators)
            else:  # decorators are evaluated outside
                outside = ast.Module(body=[ast.Expr(x) for x in child.decorator_list], type_ignores=[])
                visit(outside, path, seen, decorators)
                listed, child.decorator_list = child.decorator_list, []
                visit(child, inner_path, inner_seen, decorators)
                child.decorator_list = listed

    def _client(node: ast.Call, path: tuple[str, ...]) -> None:
        first, env = node.args[0], None
        raw = _text(first)
        if isinstance(first, ast.BinOp) and isinstance(first.op, ast.Add):
            parts, todo = [], [first]
            while todo:
                x = todo.pop()
                if isinstance(x, ast.BinOp):
                    todo += [x.right, x.left]
                elif _text(x) is not None:
                    parts.append(_text(x))
                else:
                    env = env or _env(x)
            raw = "".join(parts)
        if raw and http_target(raw):
            known = isinstance(node.func.value, ast.Name) and node.func.value.id in ("requests", "httpx")
            verb = node.func.attr.upper()
            out["service_calls"].append({"protocol": "http", "method": "ANY" if verb == "REQUEST" else verb, "raw_target": raw[:240], "framework": node.func.value.id if known else "http-client", "line": node.lineno - 1, "confidence": 0.85, "env_key": env, "caller": ".".join(path) or None})

    visit(tree, (), {}, frozenset())
    out["definitions"].sort(key=lambda d: (d.begin, -d.end))
    return out


def first_line(text: str, line: int) -> str:
    return re.sub(r"\s+$", "", text.split("\n")[line])
