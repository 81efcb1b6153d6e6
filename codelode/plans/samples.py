"""Code written by hand with every form of definition, and what the parsers must find in it, by query.

The queries append it to each file that is derived from a document.
"""

#: Texts, and (name, kind, first line, last line) of their definitions.
SAMPLES: dict[str, tuple[tuple[str, tuple[tuple[str, str, int, int], ...]], ...]] = {
    "ts_symbols": (
        (
            'export function total(items: number[]): number {\n  return items.length;\n}\n\nexport class Cart {\n  private size = 0;\n  empty(): boolean {\n    if (this.size) { return false; }\n    return true;\n  }\n}\n',
            (
                ("total", "function", 1, 3),
                ("Cart", "class", 5, 11),
                ("Cart.empty", "function", 7, 10),
            ),
        ),
        (
            'class A {\n m(a: string): Promise<{a: number}> {\n  return x;\n }\n n<T extends Foo<U>>(x: T): x is { a: T } { }\n abstract q(): void;\n get z(): () => void { return () => {}; }\n o(a = { b: 1 }): { x: number }[] { }\n}\nabstract class B { r() { } }\nexport default function top(): void { if (x) { y() } }\nfunction over(a: string): void;\nfunction over(a: any) { const t = `${`}${1}`} {`; }\nconst e = class C { s() {} };\nconst f = function g() { };\ninterface I { h(): void }\n',
            (
                ("A", "class", 1, 9),
                ("A.m", "function", 2, 4),
                ("A.n", "function", 5, 5),
                ("A.z", "function", 7, 7),
                ("A.o", "function", 8, 8),
                ("r", "function", 10, 10),
                ("top", "function", 11, 11),
                ("over", "function", 13, 13),
                ("s", "function", 14, 14),
            ),
        ),
    ),
    "js_symbols": (
        (
            'function total(items) {\n  const f = (x) => { return x; };\n  return items.map(f);\n}\n\nclass Cart {\n  constructor() { this.size = 0; }\n  get empty() {\n    return !this.size;\n  }\n}\n',
            (
                ("total", "function", 1, 4),
                ("Cart", "class", 6, 11),
                ("Cart.constructor", "function", 7, 7),
                ("Cart.empty", "function", 8, 10),
            ),
        ),
        (
            'function a() { return /"/.test(x) ? `a${ b ? "}" : `}` }` : 1 / 2; }\nfunction* gen() { yield 1; }\nclass A extends mix({ q() { } }) {\n static async *b() {}\n #c() { return a / b / c; }\n [Symbol.iterator]() {}\n}\nconst o = { d() { }, e: function() { }, async f() { } };\nif (a) { b(); }\nfoo(function () { });\n// it\'s {\nasync function z() { for (const x of y) { } while (1) { } }\n',
            (
                ("a", "function", 1, 1),
                ("A", "class", 3, 7),
                ("A.q", "function", 3, 3),
                ("A.b", "function", 4, 4),
                ("A.#c", "function", 5, 5),
                ("A.[Symbol.iterator]", "function", 6, 6),
                ("d", "function", 8, 8),
                ("f", "function", 8, 8),
                ("z", "function", 12, 12),
            ),
        ),
    ),
    "go_symbols": (
        (
            'package shop\n\ntype Cart struct {\n\tsize int\n}\n\nfunc Total(items []int) int {\n\treturn len(items)\n}\n\nfunc (c *Cart) Empty() bool {\n\treturn c.size == 0\n}\n\ntype Mode int\n',
            (
                ("Cart", "class", 3, 5),
                ("Total", "function", 7, 9),
                ("Empty", "function", 11, 13),
                ("Mode", "class", 15, 15),
            ),
        ),
        (
            'package x\ntype (\n A struct { b func() }\n B interface { M() }\n)\ntype C = int\nfunc (r *R[T]) D(x map[string]interface{}) (a, b int) {\n s := `}` + "}" + string(\'}\')\n}\nfunc E() { type F struct{}; f := func() {} }\nfunc g()\n',
            (
                ("A", "class", 3, 3),
                ("B", "class", 4, 4),
                ("D", "function", 7, 9),
                ("E", "function", 10, 10),
                ("g", "function", 11, 11),
            ),
        ),
    ),
    "cs_symbols": (
        (
            'namespace Shop;\n\npublic interface ISender\n{\n    bool Send(string to);\n}\n\npublic class Cart : ISender\n{\n    private int size;\n    public Cart(int size)\n    {\n        this.size = size;\n    }\n    public bool Send(string to) => to != "{";\n    public int Total()\n    {\n        return size;\n    }\n}\n\npublic record Item(string Name);\n',
            (
                ("ISender", "class", 3, 6),
                ("ISender.Send", "function", 5, 5),
                ("Cart", "class", 8, 20),
                ("Cart.Cart", "function", 11, 14),
                ("Cart.Send", "function", 15, 15),
                ("Cart.Total", "function", 16, 19),
                ("Item", "class", 22, 22),
            ),
        ),
        (
            'namespace N {\n [Serializable]\n public class A<T> : B where T : class {\n  string s = """\n   { "x" } \n  """;\n  [Fact]\n  [Trait("a", "b")]\n  public async Task<int> M(int x) {\n   int Local(int y) { return y; }\n   var f = new Foo(1) { X = 2 };\n   if (x > 0) { return Local(x); }\n   return $"{x}}}".Length;\n  }\n  public A() : this(new[] { 1 }) { }\n  int P { get; set; }\n  public (int, string) Pair() => (1, "}");\n  void IFoo.Bar() { }\n }\n public interface I { void Q(); }\n public struct S { public int[] Z() { return @"\\"; } }\n enum E { A }\n delegate int D(int x);\n record R(int A) { public int B() => A switch { 1 => 2, _ => 3 }; }\n}\n',
            (
                ("A", "class", 2, 19),
                ("A.M", "function", 7, 14),
                ("A.A", "function", 15, 15),
                ("A.Pair", "function", 17, 17),
                ("A.Bar", "function", 18, 18),
                ("I", "class", 20, 20),
                ("I.Q", "function", 20, 20),
                ("S", "class", 21, 21),
                ("S.Z", "function", 21, 21),
                ("R", "class", 24, 24),
                ("R.B", "function", 24, 24),
            ),
        ),
    ),
    "ps_symbols": (
        (
            'function Get-Total {\n  param($Items)\n  $Items.Count\n}\n\nclass Cart {\n  [int]$Size\n  [bool] IsEmpty() {\n    return $this.Size -eq 0\n  }\n}\n',
            (
                ("Get-Total", "function", 1, 4),
                ("Cart", "class", 6, 11),
                ("Cart.IsEmpty", "function", 8, 10),
            ),
        ),
        (
            'function A-B {\n $x = @"\n } "quoted" {\n"@\n "a `" }"\n}\nfilter F { $_ }\nclass C : D {\n [string] $n = \'}\'\n C([int]$x) : base($x) { }\n static [void] M() { if ($true) { } }\n}\n',
            (
                ("A-B", "function", 1, 6),
                ("F", "function", 7, 7),
                ("C", "class", 8, 12),
                ("C.C", "function", 10, 10),
                ("C.M", "function", 11, 11),
            ),
        ),
    ),
}
