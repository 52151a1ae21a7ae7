"""Scalar expressions that compile to Spark columns, numpy, SQL text and symbolic derivatives.

The user surface for custom similarity functions: a formula such as ``exp(-(x-y)**2 / (2*l**2))`` is parsed with
Python's own grammar (+ - * / ** unary minus, exp log sqrt sin cos abs, numbers and names) and nothing else of it.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_CALLS = {"exp": (np.exp, F.exp), "log": (np.log, F.log), "sqrt": (np.sqrt, F.sqrt), "sin": (np.sin, F.sin), "cos": (np.cos, F.cos), "abs": (np.abs, F.abs), "sign": (np.sign, F.signum)}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}


@dataclass(frozen=True)
class Node:
    """op: 'num', 'name', a function's name or one of + - * / **."""

    op: str
    args: tuple = ()

    def free(self) -> set[str]:
        return {self.args[0]} if self.op == "name" else set() if self.op == "num" else set().union(*(a.free() for a in self.args))

    def numpy(self, env: dict):
        if self.op == "num":
            return self.args[0]
        if self.op == "name":
            return env[self.args[0]]
        a = [x.numpy(env) for x in self.args]
        if self.op in _CALLS:
            return _CALLS[self.op][0](a[0])
        return {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "**": lambda x, y: np.power(x, y)}[self.op](*a)

    def column(self, env: dict) -> Column:
        if self.op == "num":
            return F.lit(float(self.args[0]))
        if self.op == "name":
            v = env[self.args[0]]
            return v if isinstance(v, Column) else F.lit(float(v))
        a = [x.column(env) for x in self.args]
        if self.op in _CALLS:
            return _CALLS[self.op][1](a[0])
        if self.op == "**" and self.args[1].op == "num" and self.args[1].args[0] == 2:
            return a[0] * a[0]
        return {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "**": F.pow}[self.op](*a)

    def sql(self, env: dict) -> str:
        if self.op == "num":
            return f"CAST({self.args[0]!r} AS DOUBLE)"
        if self.op == "name":
            v = env[self.args[0]]
            return v if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"
        a = [x.sql(env) for x in self.args]
        if self.op in _CALLS:
            return f"{'ln' if self.op == 'log' else self.op}({a[0]})"
        return f"pow({a[0]}, {a[1]})" if self.op == "**" else f"({a[0]} {self.op} {a[1]})"

    def diff(self, name: str) -> Node:
        if name not in self.free():
            return _num(0)
        if self.op == "name":
            return _num(1)
        a = self.args
        if self.op == "+":
            return _add(a[0].diff(name), a[1].diff(name))
        if self.op == "-":
            return Node("-", (a[0].diff(name), a[1].diff(name)))
        if self.op == "*":
            return _add(_mul(a[0].diff(name), a[1]), _mul(a[0], a[1].diff(name)))
        if self.op == "/":
            return Node("/", (Node("-", (_mul(a[0].diff(name), a[1]), _mul(a[0], a[1].diff(name)))), _mul(a[1], a[1])))
        if self.op == "**":
            if name not in a[1].free():
                return _mul(_mul(a[1], Node("**", (a[0], Node("-", (a[1], _num(1)))))), a[0].diff(name))
            return _mul(self, _add(_mul(a[1].diff(name), Node("log", (a[0],))), _mul(a[1], Node("/", (a[0].diff(name), a[0])))))
        inner = {
            "exp": lambda x: self,
            "log": lambda x: Node("/", (_num(1), x)),
            "sqrt": lambda x: Node("/", (_num(0.5), self)),
            "sin": lambda x: Node("cos", (x,)),
            "cos": lambda x: _mul(_num(-1), Node("sin", (x,))),
            "abs": lambda x: Node("sign", (x,)),
            "sign": lambda x: _num(0),
        }[self.op](a[0])
        return _mul(inner, a[0].diff(name))


def _num(x) -> Node:
    return Node("num", (x,))


def _add(a: Node, b: Node) -> Node:
    if a == _num(0):
        return b
    return a if b == _num(0) else Node("+", (a, b))


def _mul(a: Node, b: Node) -> Node:
    if _num(0) in (a, b):
        return _num(0)
    if a == _num(1):
        return b
    return a if b == _num(1) else Node("*", (a, b))


def parse(text: str) -> Node:
    def walk(n: ast.AST) -> Node:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return _num(n.value)
        if isinstance(n, ast.Name):
            return Node("name", (n.id,))
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return Node(_BINARY[type(n.op)], (walk(n.left), walk(n.right)))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return Node("-", (_num(0), walk(n.operand)))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and len(n.args) == 1 and not n.keywords:
            return Node(n.func.id, (walk(n.args[0]),))
        raise ValueError(f"not part of a formula: {ast.dump(n)}")

    return walk(ast.parse(text.strip(), mode="eval"))
