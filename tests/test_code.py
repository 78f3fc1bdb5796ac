"""Constructs of source files."""

import pytest

from tarn.operators import chunking as C
from tarn.operators.code import code_points, constructs, symbols

SCRIPT = """import { Database } from './db';
import type { User } from './types';

interface AuthConfig {
  secret: string;
  type: number;
}

type UserId = string;

export class AuthService<T extends object> extends Base({ a() { return 1; } }) {
  private n = 1
  constructor(private db: Database) { if (db) { go(); } }

  @log("x { y")
  private static async authenticate(user: User, token: string): Promise<{ ok: boolean }> {
    const text = `class ${user.name} { ${[1].map((x) => `export ${x}`)} function z() {}`;
    return session?.userId === user.id && /function x() {/.test(token);
  }

  abstract missing(a: string): void;
  get size(): number { return 1 }
  *walk() {}
}

/* export function hidden() {} */
// class Hidden {}
const quoted = "export class Quoted {}", other = 'function f() {}';
export function hashPassword(password: string): string {
  function inner() {}
  return crypto.createHash('sha256').update(password).digest('hex');
}
const arrow = async (a: number, b = { c: 1 }): Promise<void> => {};
const plain: (a: string) => void = function (a) {};
let value = (1 + 2) * 3;
declare function declared(): void;
const enum Level { Low }
enum Color { Red }
@Injectable({ x: 1 })
class Decorated {}
@a.b
export class Shown {}
const o = { run() {}, async stop() { return import('x'); }, key: (x) => x };
import.meta.url;
export default async function main() {}
"""


def found(text, path):
    return [(c.kind, c.name, text[c.pos:].split("\n")[0]) for c in constructs(text, path)]


def test_script():
    got = found(SCRIPT, "src/auth.ts")
    assert [(k, n) for k, n, _ in got] == [
        ("import", None), ("import", None), ("iface", "AuthConfig"), ("type", "UserId"), ("export", None), ("class", "AuthService"), ("method", "a"), ("method", "constructor"),
        ("method", "authenticate"), ("method", "size"), ("method", "walk"), ("export", None), ("func", "hashPassword"), ("func", "inner"), ("func", "arrow"), ("func", "plain"),
        ("enum", "Level"), ("enum", "Color"), ("class", "Decorated"), ("export", None), ("class", "Shown"), ("method", "run"), ("method", "stop"), ("export", None), ("func", "main"),
    ]
    starts = {n: line for _, n, line in got if n}
    assert starts["authenticate"].startswith("private static async authenticate") and starts["Decorated"].startswith("@Injectable") and starts["Level"].startswith("const enum")
    assert [line for k, _, line in got if k == "export"][2].startswith("@a.b") and starts["hashPassword"].startswith("function hashPassword")
    points = code_points(SCRIPT, "src/auth.ts")
    scores = {k: s for _, s, k in points}
    assert scores["ast:iface"] == 100 and scores["ast:method"] == scores["ast:export"] == 90 and scores["ast:import"] == 60 and scores["ast:type"] == scores["ast:enum"] == 80
    assert points == sorted(points) and points[0] == (0, 60, "ast:import")


GO = """package main

import (
\t"fmt"
)

type Server struct {
    port int // func no() {}
}

func (s *Server) Authenticate(user User) bool {
    type local int
    f := func(x int) bool { return true }
    switch user.(type) { default: }
    return f(`
func raw() {}
type Raw struct {}
` + "func s() {}" + string('"'))
}

func HashPassword[T any](password string) string {
    return "hash"
}
"""


def test_go():
    assert [(k, n) for k, n, _ in found(GO, "a.go")] == [("import", None), ("type", "Server"), ("method", "Authenticate"), ("type", "local"), ("func", "HashPassword")]


RUST = """#![allow(x)]
use std::collections::HashMap;
pub(crate) use a::b;
mod tests;

#[derive(Debug)]
pub struct AuthService<'a> {
    db: &'a Database,
    c: char,
}

impl<'a> AuthService<'a> {
    pub async unsafe fn authenticate(&self, user: &User) -> impl Fn(u8) -> bool {
        /* fn a() {} /* fn b() {} */ fn c() {} */
        let q = '"'; let l = '\\''; let r = r#"fn raw() { " "#;
        fn nested() {}
        vec![1]; println!("fn x() {{}}");
        true
    }
}

impl fmt::Display for Role { type Out = u8; }

trait Authenticatable {
    type Item;
    fn validate(&self) -> bool;
    fn given(&self) {}
}

macro_rules! make { () => { fn made() {} struct Made; } }

enum Role {
    Admin,
}
type Alias = Vec<u8>;
extern "C" fn outside() {}
fn r#match(f: fn(i32) -> i32) -> String {
    String::new()
}
"""


def test_rust():
    assert [(k, n) for k, n, _ in found(RUST, "a.rs")] == [
        ("import", None), ("import", None), ("mod", "tests"), ("struct", "AuthService"), ("impl", "AuthService"), ("func", "authenticate"), ("func", "nested"), ("impl", "Role"), ("type", "Out"),
        ("trait", "Authenticatable"), ("func", "given"), ("enum", "Role"), ("type", "Alias"), ("func", "outside"), ("func", "r#match"),
    ]
    assert next(line for k, n, line in found(RUST, "a.rs") if n == "authenticate").startswith("pub async unsafe fn")


def test_python():
    text = "from __future__ import x\nimport os\nfrom a import (b,\n  c)\n\nclass A:\n    @ dec.é\n    @other\n    async def f(self): pass\n\nif 'é': import z\n"
    assert [(k, n) for k, n, _ in found(text, "a.py")] == [("import", None), ("import", None), ("class", "A"), ("decorated", "f"), ("func", "f"), ("import", None)]
    assert found(text, "a.py")[3][2] == "@ dec.é" and found(text, "a.py")[5][2] == "import z"


@pytest.mark.parametrize("path", ["a.ts", "a.tsx", "a.go", "a.rs", "a.py", "a.js"])
def test_broken_files(path):
    for text in ["", None, "function { broken %%%", "class", "@", "@a(", "export class {", "impl", "impl<", "type", "func (", "`${", "`${`", "/*", "r#\"", "'", '"', ")]}", "({[", "const", "const a = (", "fn x(", "pub(", "class A { x", "a" * 100_000, "{" * 20_000 + "]" * 20_000, "@a.b\n" * 5_000]:
        points = constructs(text, path)
        assert all(0 <= c.pos < len(text) for c in points)
    assert constructs("class A {}", "a.md") == constructs("class A {}", None) == constructs("class A {}", "go") == []


def test_fewer_functions_are_split():
    body = "".join(f"\nexport function handler{k}(req: Request): void {{\n" + "".join(f"  const value{j} = load({j});\n\n" for j in range(12)) + "}\n" for k in range(30))
    starts = [body.index(f"function handler{k}(") for k in range(30)] + [len(body)]

    def split(parts):
        return sum(sum(p < b and p + len(x) > a for p, x in parts) > 1 for a, b in zip(starts, starts[1:]))

    auto, regex = C.chunk(body, 3600, 0, 800, "handlers.ts", "auto"), C.chunk(body, 3600, 0, 800)
    assert split(auto) == 0 < split(regex)
    assert C.chunk(body, path="readme.md", strategy="auto") == C.chunk(body) == C.chunk(body, strategy="auto")


def test_symbols(spark):
    rows = [("a.ts", "\nclass A {\n  b() {}\n}", 1), ("x.md", "class A {}", 2), ("n.go", None, 3), (None, "class A {}", 4)]
    df = symbols(spark.createDataFrame(rows, "path string, body string, line int"))
    assert [tuple(r) for r in df.orderBy("pos").collect()] == [("a.ts", 1, 2, "class", "A", 100), ("a.ts", 13, 3, "method", "b", 90)]
    assert symbols(spark.createDataFrame([], "path string, body string")).count() == 0
