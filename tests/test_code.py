import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import codegraph, codeparse
from sparkloom.service import GraphService
from sparkloom.store import GraphStore

SCRIPT = """import { shape } from "./lib/shapes";
import React from "react";

/** Draws a thing.
 *  Twice. */
export default class Board extends Base implements Drawable {
  private size = 3;
  /** Starts. */
  async start(a: number): Promise<void> {
    if (a) { shape(a); }
  }
  get width(): number { return this.size; }
}
export interface Drawable { draw(): void; hide(x: string): void }
// Adds.
const add = (a: number, b: number) => a + b
export function* walk<T>(x: T[]) { const f = function () {}; yield* x }
namespace Inner { export function deep() {} }
"""
SHARP = """using System;
using Shop.Items;
namespace Shop.Front
{
    /// <summary>Sells things.</summary>
    [Serializable]
    public sealed class Till : Base
    {
        public int Count { get; set; }
        private readonly List<int> all = new List<int>();
        public Till(int n) { Count = n; }
        /// Adds one.
        public async Task<int> Add(string name) => await Go(name);
        void Hidden() { if (x) { Call(); } }
    }
    public enum Kind { A, B }
}
"""
GO = """package shop

import "fmt"
import (
	item "example.org/x/items"
)

// Till sells.
type Till struct {
	n int
}

type (
	Kind int
	Seller interface {
		Sell(n int) error
	}
)

// Add adds.
func (t *Till) Add(n int) (int, error) {
	fmt.Println(item.New())
	return n, nil
}

func free() {}
"""
TERRAFORM = """# a comment with module "no" {
module "net" {
  source  = "../net"
  version = "1.0"
  inner {
    source = "other"
  }
}
module "reg" {
  source = "registry/x"
}
"""


def facts(path, source):
    found = codeparse.parse_file(path, source)
    pick = lambda kind, *names: [tuple(f.get(n) for n in names) for f in found if f["kind"] == kind]
    return found, pick


def test_script():
    _, pick = facts("src/board.tsx", SCRIPT)
    assert pick("Class", "qual", "signature") == [("Board", "class Board extends Base implements Drawable"), ("Drawable", "interface Drawable")]
    assert pick("Class", "docstring")[0] == ("Draws a thing.\nTwice.",)
    assert [q for q, in pick("Function", "qual")] == ["Board.start", "Board.width", "Drawable.draw", "Drawable.hide", "add", "walk", "Inner.deep"]
    assert [m for m, in pick("Function", "is_method")] == [True, True, True, True, False, False, False]
    assert pick("Function", "line_start", "line_end", "docstring")[0] == (9, 11, "Starts.")
    assert pick("IMPORTS", "target") == [("src.lib.shapes",), ("src.lib.shapes.index",)]


def test_csharp():
    _, pick = facts("Front/Till.cs", SHARP)
    assert pick("Class", "qual", "docstring") == [("Shop.Front.Till", "Sells things."), ("Shop.Front.Kind", "")]
    assert [q for q, in pick("Function", "qual")] == ["Shop.Front.Till.Till", "Shop.Front.Till.Add", "Shop.Front.Till.Hidden"]
    assert pick("IMPORTS", "target") == [("System",), ("Shop.Items",)] and pick("KEY", "target") == [("Shop.Front",)]


def test_go():
    _, pick = facts("shop/till.go", GO)
    assert [q for q, in pick("Class", "qual")] == ["Till", "Kind", "Seller"]
    assert pick("Function", "qual", "is_method") == [("Seller.Sell", True), ("Till.Add", True), ("free", False)]
    assert pick("Function", "signature", "docstring")[1] == ("func (t *Till) Add(n int) (int, error)", "Add adds.")
    assert {t for t, in pick("IMPORTS", "target")} == {"fmt", "items"} and pick("RECEIVES", "qual", "target") == [("Till.Add", "Till")]


def test_terraform():
    _, pick = facts("env/main.tf", TERRAFORM)
    assert pick("ModuleCall", "qual", "target", "version", "line_start", "line_end") == [("net", "../net", "1.0", 2, 8), ("reg", "registry/x", None, 9, 11)]
    assert pick("IMPORTS", "target") == [("net",)] and pick("KEY", "target") == [("env",)]


@pytest.mark.parametrize(("path", "source"), [("a.ts", "class A {"), ("a.py", "def ("), ("a.cs", "}"), ("a.go", "func f() {")])
def test_broken_files_are_errors(path, source):
    assert [f["kind"] for f in codeparse.parse_file(path, source)] == ["Error"]
    assert codeparse.parse_file("a.txt", source) == []


def edges_of(service, name):
    graph = service.store.graph()
    return {(r["_src"].partition(":")[2], r["_dst"].partition(":")[2]) for r in graph.rels[name].collect()}


def test_ingest_code(spark, tmp_path):
    root = tmp_path / "proj"
    for path, text in {
        "pkg/__init__.py": "", "pkg/base.py": "class Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return helper()\n\ndef helper():\n    return 1\n",
        "pkg/more.py": "from .base import Base, helper\n\nclass More(Base):\n    def go(self):\n        return helper()\n",
        "web/board.ts": 'import { x } from "./shapes";\nexport class B { run() {} }\n', "web/shapes.ts": "export const x = () => 1;\n",
        "shop/a.go": "package shop\n\ntype Till struct {}\n", "shop/b.go": "package shop\n\nfunc (t Till) Add() {}\n",
        "infra/main.tf": 'module "c" {\n  source = "./child"\n}\n', "infra/child/main.tf": "",
        "bad.py": "def (", "old.rb": "x", "node_modules/no.js": "function f() {}", "web/lib.min.js": "function f() {}", "web/app-C2RYf8Fw.js": "function f() {}", "big.py": "#" * 3000,
    }.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(text)
    service = GraphService(GraphStore(spark, str(tmp_path / "store")))
    report = service.ingest_code(str(root), max_kb=2)
    assert (report.repos, report.modules, report.classes, report.functions, report.module_calls) == (1, 9, 4, 7, 1)
    assert sorted(w.split(":")[0].split(" of")[0] for w in report.warnings) == ["skipped 1 files", "skipped bad.py", "skipped big.py"]
    assert edges_of(service, "IMPORTS") == {("pkg/more.py", "pkg/base.py"), ("web/board.ts", "web/shapes.ts"), ("infra/main.tf", "infra/child/main.tf")}
    assert edges_of(service, "INHERITS") == {("pkg/more.py#More", "pkg/base.py#Base")}
    assert edges_of(service, "CALLS") == {("pkg/base.py#Base.run", "pkg/base.py#Base.step"), ("pkg/base.py#Base.step", "pkg/base.py#helper"), ("pkg/more.py#More.go", "pkg/base.py#helper")}
    assert ("shop/a.go#Till", "shop/b.go#Till.Add") in edges_of(service, "CONTAINS_CLASS_FUNCTION")
    # ids without a digest, of an earlier time, go, and so do a function and a file; a file that no longer parses keeps what it gave
    modules = service.store.table("Module")
    service.upsert_nodes("Repo", spark.createDataFrame([("proj", os.path.realpath(root))], "id string, path string"))
    service.store.replace({"Module": modules.union(modules.where("path = 'pkg/base.py'").withColumn("id", F.lit("proj:pkg/base.py")))})
    (root / "pkg/more.py").write_text("from .base import Base\n\nclass More(Base):\n    pass\n")
    (root / "web/shapes.ts").unlink()
    (root / "pkg/base.py").write_text("class (")
    report = service.ingest_code(str(root), max_kb=2)
    graph = service.store.graph()
    left = {r["id"].partition(":")[2] for label in ("Module", "Class", "Function") for r in graph.nodes[label].collect()}
    assert "pkg/more.py#More.go" not in left and "web/shapes.ts" not in left and {"pkg/base.py#helper", "pkg/base.py"} <= left
    assert report.nodes_pruned == 5 and ("web/board.ts", "web/shapes.ts") not in edges_of(service, "IMPORTS")
    assert ("pkg/base.py#Base.run", "pkg/base.py#Base.step") in edges_of(service, "CALLS")
    assert [r["id"] for r in service.store.table("Repo").collect()] == [codegraph.repo_id(str(root))]
    paths = spark.createDataFrame([("one", "pkg/base.py"), ("two", "nowhere")], "name string, path string")
    assert [(r["name"], r["module_id"].partition(":")[2]) for r in codegraph.match_paths(paths, "path", service.store.table("Module").select("path", "id")).collect()] == [("one", "pkg/base.py")]
    assert codegraph.commits_behind(str(root), None) is None and codegraph.repo_id(str(root)).startswith("proj-") and len(codegraph.repo_id(str(root))) == 5 + 64

HARD_SCRIPT = r'''import { a } from "./a";
const clean = (s: string) => s.replace(/[{]/g, "").replace(/\/\*/, `x`);
export class Deep<T extends Map<string, { n: number }>> extends Base<T> {
  private half = this.size / 2; other = 4 / 2;
  name(x: number): string { return `a ${x > 1 ? `b ${[1].map((y) => `{${y}`)}` : "}"} c`; }
  pick<K extends Map<string, Set<T>>>(key: K, opts: { deep: boolean; run(x: number): void }): { k: K } { return { k: key }; }
  test(v: string) { if (v) /}{/.test(v); return v.length! / 2 / 3; }
}
export function View({ title, items }: Props) {
  return (<div a={1} />);
}
export const Card: FC<Props> = ({ a, b }: Props): Promise<{ x: number }> => { return null; };
const late = <T,>(x: T) => x;
function last() { return /[/{]/; }
'''
HARD_SHARP = r'''using System;
namespace A.B;
public class Q : Base {
    string raw = """ a { "x" """;
    string v = @"c:\{""quoted""}";
    public string Hi(string n) => $"{{ {n.Replace("{", "}")} {d["k"]}";
    public string Two(int n = 3) { return $@"a {n:{0}} ""b"" { (n > 1 ? "}" : "{") }"; }
    char c = '{';
    void Last() { }
}
'''
HARD_GO = r'''package x

var s = `a { \`

type T[K comparable] struct{ n map[string]struct{ a int } }

func (t *T[K]) Run(f func(x struct{ a int }) error) (m map[string]interface{}, err error) {
	r := '{'
	return nil, nil
}
func Last() {}
'''
HARD_TERRAFORM = r'''resource "a" "b" {
  x = "${lookup(var.m, "k}")}-$${"
  y = <<-EOT
    { not closed "
  EOT
}
module "net" {
  source = "../net"
}
'''


def test_literals_with_code_in_them():
    _, pick = facts("x.tsx", HARD_SCRIPT)
    assert pick("Class", "qual", "line_start", "line_end") == [("Deep", 3, 8)]
    assert pick("Function", "qual", "line_start", "line_end") == [("clean", 2, 2), ("Deep.name", 5, 5), ("Deep.pick", 6, 6), ("Deep.test", 7, 7), ("View", 9, 11), ("Card", 12, 12), ("late", 13, 13), ("last", 14, 14)]
    assert dict(pick("Function", "qual", "signature"))["View"] == "function View({ title, items }: Props)"
    _, pick = facts("x.cs", HARD_SHARP)
    assert pick("Function", "qual", "line_start") == [("A.B.Q.Hi", 6), ("A.B.Q.Two", 7), ("A.B.Q.Last", 9)]
    _, pick = facts("x.go", HARD_GO)
    assert pick("Class", "qual") == [("T",)] and pick("Function", "qual", "line_end") == [("T.Run", 10), ("Last", 11)]
    _, pick = facts("d/x.tf", HARD_TERRAFORM)
    assert pick("ModuleCall", "name", "target") == [("net", "../net")]


@pytest.mark.parametrize("source", ["const x = `${`", "f(`a ${b", "x = { `${ `"])
def test_unclosed_literals_are_errors(source):
    assert [f["kind"] for f in codeparse.parse_file("x.ts", source)] == ["Error"]


@pytest.mark.parametrize("code", ["a / 2; b = /[/]{/", "x) / 2 / 3", "`${a}/${`}`}` / 2", "return /{/", "<A b={1} /> / {}", "i++ / 2", "a => /}/.test(a)"])
def test_slashes(code):
    source = f"f({code});\nfunction after() {{}}\n" if not code.startswith("x)") else f"f({code};\nfunction after() {{}}\n"
    _, pick = facts("x.ts", source)
    assert pick("Function", "qual") == [("after",)]
