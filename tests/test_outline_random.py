"""Scope paths from the window-based outline against a brute-force stack
model, on random nestings of scopes, plain blocks and functions."""

import random

from markscope.operators.outline import symbols


def _py(rng, depth, prefix, out, expect, scope_ok, indent):
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["class", "def", "if", "deco"] if depth < 3 else ["def", "pass"])
        pad = " " * indent
        if kind == "pass":
            out.append(pad + "x = 1")
            continue
        name = f"n{len(out)}"
        if kind == "if":
            out.append(pad + "if cond:")
            _py(rng, depth + 1, prefix, out, expect, False, indent + 4)
            continue
        decorated = kind == "deco"
        if decorated:
            out.append(pad + "@wrap(1,")
            out.append(pad + "      2)")
            kind = rng.choice(["class", "def"])
        out.append(pad + f"{'class' if kind == 'class' else 'def'} {name}():")
        if scope_ok:
            expect.append((prefix + [name]))
        if rng.random() < 0.3:
            out.append("")
            out.append(pad + "    # comment class Fake:")
        # only undecorated classes are walked into
        walk = scope_ok and kind == "class" and not decorated
        if depth < 3 and rng.random() < 0.8:
            _py(rng, depth + 1, prefix + [name], out, expect, walk, indent + 4)
        else:
            out.append(pad + "    pass")


def _rs(rng, depth, prefix, out, expect, scope_ok, indent):
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["mod", "fn", "block", "struct"] if depth < 3 else ["fn", "struct"])
        pad = " " * indent
        name = f"n{len(out)}"
        if kind == "struct":
            out.append(pad + f"struct {name} {{ a: u8 }}")
            if scope_ok:
                expect.append(prefix + [name])
            continue
        if kind == "block":
            out.append(pad + "const _: () = {")
            _rs(rng, depth + 1, prefix, out, expect, False, indent + 4)
            out.append(pad + "};")
            continue
        out.append(pad + f"{'mod' if kind == 'mod' else 'fn'} {name}() {{" if kind == "fn" else pad + f"mod {name} {{")
        if scope_ok:
            expect.append(prefix + [name])
        if depth < 3 and rng.random() < 0.8:
            _rs(rng, depth + 1, prefix + [name], out, expect, scope_ok and kind == "mod", indent + 4)
        out.append(pad + "}")


def test_random_nesting(spark):
    rng = random.Random(7)
    rows, expected = [], set()
    for i in range(12):
        for lang, gen in (("python", _py), ("rust", _rs)):
            out, exp = [], []
            gen(rng, 0, [], out, exp, True, 0)
            path = f"f{i}.{'py' if lang == 'python' else 'rs'}"
            rows.append((path, lang, "\n".join(out) + "\n"))
            expected |= {(path, " > ".join(e)) for e in exp}
    df = spark.createDataFrame(rows, "path string, language string, content string")
    got = {(r.path, r.scope_path) for r in symbols(df).where("role <> 'ignorable'").collect()}
    assert len(expected) > 50 and any(p.count(">") >= 2 for _, p in expected)
    assert got == expected
