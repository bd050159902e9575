"""Operators on Python source text. Only the parser of the running interpreter is used; nothing is ever executed.

Arrow UDFs, because Spark has no Python parser. Null gives null; text that does not parse gives the documented value.
"""

from __future__ import annotations

import ast
import builtins
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

FENCE = r"(?is)\A\s*```(?:python|py)?[ \t]*\n(.*?)\n?```\s*\z"


def unfenced(text: Column) -> Column:
    """Code inside one outer fence, else the text; ends stripped."""
    inner = F.regexp_extract(text, FENCE, 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(F.regexp_replace(text, "\r\n?", "\n")), r"(?U)\A\s+|\s+\z", "")


def _tree(code: str | None):
    try:
        return None if code is None else ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _each(fn, kind):
    @F.arrow_udf(kind)
    def run(codes: pa.Array) -> pa.Array:
        return pa.array([None if c is None else fn(c) for c in codes.to_pylist()])

    return run


def _dump(code: str) -> str:
    tree = _tree(code)
    return "" if tree is None else ast.dump(tree, include_attributes=False)


canonical_ast = _each(_dump, StringType())


def code_problem(code: Column, fenced: Column) -> Column:
    """'' for code that parses, else missing_code, invalid_code_fence or invalid_python."""
    return F.when(code.isNull(), "output_must_be_string").when(code == "", "missing_code").when(canonical_ast(code) != "", "").when(F.contains(fenced, F.lit("```")) & F.contains(code, F.lit("```")), "invalid_code_fence").otherwise("invalid_python")


def _bindings(code: str) -> list[str]:
    """Names bound at module scope, in order; function, class and comprehension bodies do not count."""
    tree, found = _tree(code), []

    def visit(node):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append(node.name)
            return
        if isinstance(node, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            return
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            found.extend((a.asname or a.name.split(".")[0]) for a in node.names if a.name != "*")
            return
        if isinstance(node, ast.ExceptHandler) and node.name:
            found.append(node.name)
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            found.append(node.id)
        for child in ast.iter_child_nodes(node):
            visit(child)

    if tree is not None:
        visit(tree)
    return list(dict.fromkeys(found))


module_bindings = _each(_bindings, ArrayType(StringType()))


def _doc_variants(code: str) -> list[str]:
    """The text itself and the docstrings of module and functions, each also without its assert lines."""
    tree, out = _tree(code), [code]
    if tree is not None:
        for node in [tree, *(n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))]:
            if doc := ast.get_docstring(node):
                out += [doc, "\n".join(x for x in doc.splitlines() if not x.lstrip().startswith("assert"))]
    return list(dict.fromkeys(x for x in out if x.strip()))


text_variants = _each(_doc_variants, ArrayType(StringType()))


@F.arrow_udf(StringType())
def entry_point(codes: pa.Array, calls: pa.Array) -> pa.Array:
    """The only name that the code defines and the calls use; null for none or several."""
    out = []
    for code, call in zip(codes.to_pylist(), calls.to_pylist()):
        a, b = _tree(code), _tree(call)
        made = {n.name for n in ast.walk(a) if isinstance(n, (ast.FunctionDef, ast.ClassDef))} if a else set()
        used = {n.func.id for n in ast.walk(b) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)} - set(dir(builtins)) if b else set()
        both = made & used
        out.append(both.pop() if len(both) == 1 else None)
    return pa.array(out, pa.string())


_ALIASED = StructType([StructField("code", StringType()), StructField("changed", IntegerType())])


@F.arrow_udf(_ALIASED)
def with_alias(codes: pa.Array, wanted: pa.Array) -> pa.Array:
    """Code that binds the wanted name: where it is missing and exactly one function is defined, an alias line is added."""
    out = []
    for code, name in zip(codes.to_pylist(), wanted.to_pylist()):
        tree = _tree(code)
        functions = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if tree else []
        add = code is not None and name is not None and name not in _bindings(code) and len(functions) == 1 and name.isidentifier()
        out.append({"code": f"{code.rstrip()}\n\n{name} = {functions[0]}\n" if add else code, "changed": int(add)})
    return pa.array(out, pa.struct([("code", pa.string()), ("changed", pa.int32())]))


_STABLE = LongType()


@F.arrow_udf(_STABLE)
def stable_seed(parts: pa.Array) -> pa.Array:
    """A 63-bit seed of a text, the same on every platform: blake2b of its UTF-8 bytes."""
    import hashlib

    return pa.array([None if p is None else int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") % (2**63 - 1) for p in parts.to_pylist()], pa.int64())


def _unmatched(value: str) -> str:
    """'' or the fault of alignment characters: an unescaped & outside an environment that allows it, or environments that do not nest."""
    # Environments with alignment.
    allowed = {"matrix", "pmatrix", "bmatrix", "vmatrix", "cases", "array"}
    bare = re.sub(r"\\[^A-Za-z]", "", value)
    if "&" not in bare:
        return ""
    stack: list[str] = []
    for m in re.finditer(r"\\begin\{([^}]*)\}|\\end\{([^}]*)\}|&", bare):
        if m[1] is not None:
            stack.append(m[1])
        elif m[2] is not None:
            if not stack or stack.pop() != m[2]:
                return "invalid_alignment_environment"
        elif not stack or stack[-1] not in allowed:
            return "unescaped_ampersand"
    return "invalid_alignment_environment" if stack else ""


tex_alignment = _each(_unmatched, StringType())

#: Ways to treat a program before it is judged: whether the cleaner runs, and which function gets the wanted name.
MODES = ("raw", "valid_first", "sanitize", "alias_single", "alias_last", "valid_first_alias_single", "sanitize_alias_single")
COUNTERS = ("applied", "cleaned", "existing_binding", "no_function", "ambiguous", "invalid_source")


def longest_program(code: str, wanted: str | None = None) -> str:
    """The longest run of lines that parses, without its outer fences; of its definitions only those that the wanted name needs."""
    lines = [x for x in code.splitlines() if not x.lstrip().startswith("```")]
    best: tuple[int, int] = (0, 0)
    for i in range(len(lines)):
        if len(lines) - i <= best[1] - best[0]:
            break
        for j in range(len(lines), i + best[1] - best[0], -1):
            if _tree("\n".join(lines[i:j])) is not None:
                best = (i, j)
                break
    text = "\n".join(lines[best[0] : best[1]])
    tree = _tree(text)
    if wanted is None or tree is None or wanted not in _bindings(text):
        return text
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    uses = {n.name: {x.id for x in ast.walk(n) if isinstance(x, ast.Name)} for n in tree.body if isinstance(n, kinds)}
    needed, queue = set(), [wanted, *(x.id for n in tree.body if not isinstance(n, kinds) for x in ast.walk(n) if isinstance(x, ast.Name))]
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += uses.get(name, ())
    return "\n".join(ast.unparse(n) for n in tree.body if not isinstance(n, kinds) or n.name in needed)


def transformed(code: str, wanted: str, mode: str) -> tuple[str, dict[str, int]]:
    """The program in one of the modes, and what was done to it."""
    done = dict.fromkeys(COUNTERS, 0)

    def clean(text: str, name: str | None) -> str:
        done["cleaned"] += 1
        return longest_program(text, name)

    first, _, alias = mode.partition("_alias") if mode.startswith(("valid", "sanitize")) else ("", "", mode.removeprefix("alias") if mode != "raw" else "")
    if mode == "raw":
        return code, done
    if first == "sanitize" and not alias:
        return clean(code, wanted), done
    if first == "sanitize":
        code = clean(code, None)
    tree = _tree(code)
    if first == "valid_first":
        if tree is None:
            return clean(code, wanted), done
        if not alias:
            return code, done
    finish = (lambda text: clean(text, wanted)) if first == "sanitize" else (lambda text: text)
    if tree is None:
        done["invalid_source"] = 1
        return code, done
    if wanted in _bindings(code):
        done["existing_binding"] = 1
        return finish(code), done
    functions = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if not functions or (alias == "_single" and len(functions) > 1):
        done["ambiguous" if functions else "no_function"] = 1
        return code, done
    done["applied"] = 1
    return finish(f"{code.rstrip()}\n\n{wanted} = {functions[-1]}\n"), done


def transformer(mode: str):
    """A function of (program, wanted name) in one mode: (code, counters). Null for a null part; an unknown mode raises ValueError."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    kind = StructType([StructField("code", StringType()), *(StructField(c, IntegerType()) for c in COUNTERS)])

    @F.arrow_udf(kind)
    def run(codes: pa.Array, wanted: pa.Array) -> pa.Array:
        made = [None if c is None or w is None else transformed(c, w, mode) for c, w in zip(codes.to_pylist(), wanted.to_pylist())]
        return pa.array([None if m is None else {"code": m[0], **m[1]} for m in made], pa.struct([("code", pa.string()), *((c, pa.int32()) for c in COUNTERS)]))

    return run
