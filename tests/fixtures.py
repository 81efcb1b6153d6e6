"""Texts that the parsers are tried on, and the rows that they call for."""

IGNORE_LINES = ["# comment", "*.log", "/knowledge/", "tmp/", "!keep.log", "docs/*.draft.md", "**/gen/*.py", "file?.txt", "[ab].rs"]
IGNORED = [
    ("a.log", True),
    ("x/b.log", True),
    ("x/keep.log", False),
    ("knowledge/a.py", True),
    ("src/knowledge/a.py", False),
    ("src/tmp/x.py", True),
    ("tmp.py", False),
    ("docs/a.draft.md", True),
    ("docs/sub/a.draft.md", False),
    ("gen/a.py", True),
    ("x/y/gen/b.py", True),
    ("x/gen/y/b.py", False),
    ("file1.txt", True),
    ("file12.txt", False),
    ("q/a.rs", True),
    ("q/c.rs", False),
]

FILES = {
    "guide.md": "# Shop\nIntro\n## Install #\nsteps\n\n### Before\nnone\n## Use\ntext\n# Other\nend\n",
    "fences.md": "# A\n```sh\n# not a heading\n~~~\n## B\n```\n# hidden\n```\n#nospace\n### C\n",
    "tool.yaml": "# top\nname: 'Seven Tools'\nversion: 3\n\ninstall:\n  run: x\n  # note\n\nremove: [a, b]\n",
    "plain.yml": "id:\nsteps:\n  - a\nproduct: Widget # kept\n",
    "src/Shop.csproj": '<Project Sdk="x">\n  <PropertyGroup>\n    <TargetFramework>net8.0</TargetFramework>\n    <Nullable>enable</Nullable>\n  </PropertyGroup>\n  <ItemGroup>\n    <PackageReference Include="Polly.Core.Ext" Version="1" />\n    <ProjectReference Include="..\\Base\\Shop.Base.csproj" />\n  </ItemGroup>\n</Project>\n',
    "Directory.Build.props": "<Project>\n  <PropertyGroup>\n    <VersionPrefix>1.2</VersionPrefix>\n  </PropertyGroup>\n</Project>\n",
    "Stamp.targets": '<Project>\n  <Target Name="Stamp" BeforeTargets="Build">\n    <Message Text="hello" />\n    <Exec Command="run" />\n  </Target>\n</Project>\n',
    "src/Odd.csproj": '<Project>\n  <!-- <ItemGroup> -->\n  <PropertyGroup Label="x" />\n  <PropertyGroup Condition="\'$(A)\' > \'1\'">\n    <!-- <Hidden /> -->\n    <x:Deep><Inner>1</Inner></x:Deep>\n    <Flag/>\n  </PropertyGroup>\n  <ItemGroup>\n    <Compile Remove=" ; a" Update="b/R&amp;D.cs;c" />\n    <ProjectReference Include="..\\Q\\My.Lib.csproj"/>\n    <None Include=\'x y.txt\'><Link>z</Link></None>\n  </ItemGroup>\n  <Target Name="Two Steps">\n    <PropertyGroup><Mode>1</Mode></PropertyGroup>\n    <Copy SourceFiles="a" />\n  </Target>\n</Project>\n',
    "deep.md": "###### Six\n# One\n### Three\n## Two\n#### Four\n### Three again\n```\n# no\n~~~\n# One more\n## Two more\n### Last ###\n",
    "Torn.csproj": '<Project>\n  <PropertyGroup>\n    <OutputType>Exe</OutputType>\n  </PropertyGroup>\n  <ItemGroup>\n    <PackageReference Include="NLog">\n    </PackageReference>\n',
    "shop.py": 'import os\n\n\ndef total(items):\n    """Sum."""\n    def price(i):\n        return i\n\n    return sum(price(i) for i in items)\n\n\nclass Cart:\n    size = 0\n\n    @property\n    def empty(self):\n        return not self.size\n\n    async def send(self):\n        pass\n',
    "shop.rs": 'pub fn total(items: &[u32]) -> u32 {\n    // }\n    let s = "{";\n    items.iter().sum()\n}\n\npub struct Cart {\n    size: usize,\n}\n\nenum Mode {\n    Fast,\n}\n\npub trait Sender {\n    fn send(&self) -> bool;\n}\n\nimpl Cart {\n    fn empty(&self) -> bool {\n        self.size == 0\n    }\n}\n\nimpl Sender for Cart {\n    fn send(&self) -> bool {\n        true\n    }\n}\n',
    "deploy.sh": '#!/bin/bash\nbuild() {\n  echo "}"\n}\n\nfunction ship {\n  build # }\n}\n',
    "cart.ts": "export function total(items: number[]): number {\n  return items.length;\n}\n\nexport class Cart {\n  private size = 0;\n  empty(): boolean {\n    if (this.size) { return false; }\n    return true;\n  }\n}\n",
    "cart.js": "function total(items) {\n  const f = (x) => { return x; };\n  return items.map(f);\n}\n\nclass Cart {\n  constructor() { this.size = 0; }\n  get empty() {\n    return !this.size;\n  }\n}\n",
    "shop.go": 'package shop\n\ntype Cart struct {\n\tsize int\n}\n\nfunc Total(items []int) int {\n\treturn len(items)\n}\n\nfunc (c *Cart) Empty() bool {\n\treturn c.size == 0\n}\n\ntype Mode int\n',
    "Shop.cs": 'namespace Shop;\n\npublic interface ISender\n{\n    bool Send(string to);\n}\n\npublic class Cart : ISender\n{\n    private int size;\n    public Cart(int size)\n    {\n        this.size = size;\n    }\n    public bool Send(string to) => to != "{";\n    public int Total()\n    {\n        return size;\n    }\n}\n\npublic record Item(string Name);\n',
    "Shop.ps1": "function Get-Total {\n  param($Items)\n  $Items.Count\n}\n\nclass Cart {\n  [int]$Size\n  [bool] IsEmpty() {\n    return $this.Size -eq 0\n  }\n}\n",
    "odd.rs": 'fn a() -> [u8; 4] {\n  [0;\n 4]\n}\nfn b() { let s = r#"a " { "#; /* x /* y */ { */ }\nmod t { fn c<\'a>(x: &\'a str) -> char { \'}\' } }\nmacro_rules! m { ($x:expr) => { fn hidden() {} }; }\nimpl<T> Foo<T> where T: Copy {\n fn d(&self) { println!("{}", 1); }\n}\nstruct P(u8, [u8; 3]);\nenum E { A { x: u8 }, B }\nunsafe impl Send for E {}\ntrait T { const N: usize; fn e(&self) -> [u8; 2]; fn f(&self) {} }\n',
    "odd.ts": 'class A {\n m(a: string): Promise<{a: number}> {\n  return x;\n }\n n<T extends Foo<U>>(x: T): x is { a: T } { }\n abstract q(): void;\n get z(): () => void { return () => {}; }\n o(a = { b: 1 }): { x: number }[] { }\n}\nabstract class B { r() { } }\nexport default function top(): void { if (x) { y() } }\nfunction over(a: string): void;\nfunction over(a: any) { const t = `${`}${1}`} {`; }\nconst e = class C { s() {} };\nconst f = function g() { };\ninterface I { h(): void }\n',
    "odd.js": 'function a() { return /"/.test(x) ? `a${ b ? "}" : `}` }` : 1 / 2; }\nfunction* gen() { yield 1; }\nclass A extends mix({ q() { } }) {\n static async *b() {}\n #c() { return a / b / c; }\n [Symbol.iterator]() {}\n}\nconst o = { d() { }, e: function() { }, async f() { } };\nif (a) { b(); }\nfoo(function () { });\n// it\'s {\nasync function z() { for (const x of y) { } while (1) { } }\n',
    "Odd.cs": 'namespace N {\n [Serializable]\n public class A<T> : B where T : class {\n  string s = """\n   { "x" } \n  """;\n  [Fact]\n  [Trait("a", "b")]\n  public async Task<int> M(int x) {\n   int Local(int y) { return y; }\n   var f = new Foo(1) { X = 2 };\n   if (x > 0) { return Local(x); }\n   return $"{x}}}".Length;\n  }\n  public A() : this(new[] { 1 }) { }\n  int P { get; set; }\n  public (int, string) Pair() => (1, "}");\n  void IFoo.Bar() { }\n }\n public interface I { void Q(); }\n public struct S { public int[] Z() { return @"\\"; } }\n enum E { A }\n delegate int D(int x);\n record R(int A) { public int B() => A switch { 1 => 2, _ => 3 }; }\n}\n',
    "odd.sh": 'a() {\n cat <<EOF\n }\nEOF\n echo "$(echo "}")" ${x#\\}}\n}\nfunction b { cat <<-\'X\'\n\t}\n\tX\n}\nc() ( echo 1 )\nd()\n{\n  case $x in a) ;; esac # }\n  y=$((1 << 2))\n}\n',
    "Odd.ps1": 'function A-B {\n $x = @"\n } "quoted" {\n"@\n "a `" }"\n}\nfilter F { $_ }\nclass C : D {\n [string] $n = \'}\'\n C([int]$x) : base($x) { }\n static [void] M() { if ($true) { } }\n}\n',
    "odd.go": 'package x\ntype (\n A struct { b func() }\n B interface { M() }\n)\ntype C = int\nfunc (r *R[T]) D(x map[string]interface{}) (a, b int) {\n s := `}` + "}" + string(\'}\')\n}\nfunc E() { type F struct{}; f := func() {} }\nfunc g()\n',
    "odd.py": 'class A:\n  def x(self):\n    pass\n  def (\n\ndef y():\n\tif 1:\n\t\tpass\n\n\n# end\nz = 1\n',
}

MARKDOWN = [
    ("guide.md", "Shop", 1, 9),
    ("guide.md", "Shop.Install", 3, 7),
    ("guide.md", "Shop.Install.Before", 6, 7),
    ("guide.md", "Shop.Use", 8, 9),
    ("guide.md", "Other", 10, 11),
    ("fences.md", "A", 1, 10),
    ("fences.md", "A.B", 5, 10),
    ("fences.md", "A.B.C", 10, 10),
    ("deep.md", "Six", 1, 1),
    ("deep.md", "One", 2, 9),
    ("deep.md", "One.Three", 3, 3),
    ("deep.md", "One.Two", 4, 9),
    ("deep.md", "One.Two.Four", 5, 5),
    ("deep.md", "One.Two.Three again", 6, 9),
    ("deep.md", "One more", 10, 12),
    ("deep.md", "One more.Two more", 11, 12),
    ("deep.md", "One more.Two more.Last", 12, 12),
]
FENCED = [("fences.md", 1, 1, "A"), ("fences.md", 5, 2, "B"), ("fences.md", 10, 3, "C")]
YAML = [
    ("tool.yaml", "Seven Tools.name", 2, 2),
    ("tool.yaml", "Seven Tools.version", 3, 4),
    ("tool.yaml", "Seven Tools.install", 5, 8),
    ("tool.yaml", "Seven Tools.remove", 9, 9),
    ("plain.yml", "Widget # kept.id", 1, 1),
    ("plain.yml", "Widget # kept.steps", 2, 3),
    ("plain.yml", "Widget # kept.product", 4, 4),
]
MSBUILD = [
    ("src/Shop.csproj", "Shop.PropertyGroup.TargetFramework.Nullable", 2, 5),
    ("src/Shop.csproj", "Shop.ItemGroup.PackageReference.Polly Core Ext.ProjectReference.Shop Base", 6, 9),
    ("Directory.Build.props", "Directory Build.PropertyGroup.VersionPrefix", 2, 4),
    ("Stamp.targets", "Stamp.Target.Stamp.Message.Exec", 2, 5),
    ("src/Odd.csproj", "Odd.ItemGroup.PropertyGroup.PropertyGroup.ItemGroup", 2, 13),
    ("src/Odd.csproj", "Odd.PropertyGroup.Deep.Flag", 3, 8),
    ("src/Odd.csproj", "Odd.PropertyGroup.Deep.Flag", 4, 8),
    ("src/Odd.csproj", "Odd.ItemGroup.Compile.R D cs.ProjectReference.My Lib.None.x y txt", 9, 13),
    ("src/Odd.csproj", "Odd.Target.Two Steps.PropertyGroup.Copy", 14, 17),
    ("src/Odd.csproj", "Odd.PropertyGroup.Mode", 15, 15),
]
MSBUILD_BROKEN = [("Torn.csproj", "Torn.PropertyGroup.OutputType", 2, 4), ("Torn.csproj", "Torn.ItemGroup.PackageReference.NLog", 5, 8)]
CODE = {
    "shop.py": [("total", "function", 4, 9), ("total.price", "function", 6, 7), ("Cart", "class", 12, 20), ("Cart.empty", "function", 16, 17), ("Cart.send", "function", 19, 20)],
    "shop.rs": [("total", "function", 1, 5), ("Cart", "class", 7, 9), ("Mode", "class", 11, 13), ("Sender", "class", 15, 17), ("Sender.send", "function", 16, 16), ("Cart.empty", "function", 20, 22), ("Cart.send", "function", 26, 28)],
    "deploy.sh": [("build", "function", 2, 4), ("ship", "function", 6, 8)],
    "cart.ts": [("total", "function", 1, 3), ("Cart", "class", 5, 11), ("Cart.empty", "function", 7, 10)],
    "cart.js": [("total", "function", 1, 4), ("Cart", "class", 6, 11), ("Cart.constructor", "function", 7, 7), ("Cart.empty", "function", 8, 10)],
    "shop.go": [("Cart", "class", 3, 5), ("Total", "function", 7, 9), ("Empty", "function", 11, 13), ("Mode", "class", 15, 15)],
    "Shop.cs": [("ISender", "class", 3, 6), ("ISender.Send", "function", 5, 5), ("Cart", "class", 8, 20), ("Cart.Cart", "function", 11, 14), ("Cart.Send", "function", 15, 15), ("Cart.Total", "function", 16, 19), ("Item", "class", 22, 22)],
    "Shop.ps1": [("Get-Total", "function", 1, 4), ("Cart", "class", 6, 11), ("Cart.IsEmpty", "function", 8, 10)],
    "odd.rs": [("a", "function", 1, 4), ("b", "function", 5, 5), ("c", "function", 6, 6), ("Foo<T>.d", "function", 9, 9), ("P", "class", 11, 11), ("E", "class", 12, 12), ("T", "class", 14, 14), ("T.e", "function", 14, 14), ("T.f", "function", 14, 14)],
    "odd.ts": [("A", "class", 1, 9), ("A.m", "function", 2, 4), ("A.n", "function", 5, 5), ("A.z", "function", 7, 7), ("A.o", "function", 8, 8), ("r", "function", 10, 10), ("top", "function", 11, 11), ("over", "function", 13, 13), ("s", "function", 14, 14)],
    "odd.js": [("a", "function", 1, 1), ("A", "class", 3, 7), ("A.q", "function", 3, 3), ("A.b", "function", 4, 4), ("A.#c", "function", 5, 5), ("A.[Symbol.iterator]", "function", 6, 6), ("d", "function", 8, 8), ("f", "function", 8, 8), ("z", "function", 12, 12)],
    "Odd.cs": [("A", "class", 2, 19), ("A.M", "function", 7, 14), ("A.A", "function", 15, 15), ("A.Pair", "function", 17, 17), ("A.Bar", "function", 18, 18), ("I", "class", 20, 20), ("I.Q", "function", 20, 20), ("S", "class", 21, 21), ("S.Z", "function", 21, 21), ("R", "class", 24, 24), ("R.B", "function", 24, 24)],
    "odd.sh": [("a", "function", 1, 6), ("b", "function", 7, 10), ("c", "function", 11, 11), ("d", "function", 12, 16)],
    "Odd.ps1": [("A-B", "function", 1, 6), ("F", "function", 7, 7), ("C", "class", 8, 12), ("C.C", "function", 10, 10), ("C.M", "function", 11, 11)],
    "odd.go": [("A", "class", 3, 3), ("B", "class", 4, 4), ("D", "function", 7, 9), ("E", "function", 10, 10), ("g", "function", 11, 11)],
    "odd.py": [("A", "class", 1, 4), ("A.x", "function", 2, 3), ("y", "function", 6, 8)],
}
