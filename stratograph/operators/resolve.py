"""Edge resolution: import specs to files, call names to symbols, routes to handlers, containment.

Nothing here joins all candidates of a name with all its uses. Symbols are first aggregated per (name),
(file, name) and (class, name) to a count and two ids, which is enough to tell whether exactly one
candidate remains once the caller itself is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratograph.functions.paths import clean
from stratograph.graph import CALLS, CONTAINS, EXPOSES_ROUTE, HANDLED_BY, IMPORTS, as_edges, short_name
from stratograph.operators.skew import skew_join

#: Suffixes tried on a module path, in order.
SUFFIXES = ["", ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".go", ".java", ".kt", ".kts", ".cs", ".swift", ".php", ".rs", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp",
            "/__init__.py", "/index.ts", "/index.tsx", "/index.js", "/mod.rs"]
#: Folders an absolute module path may start in, in order.
PREFIXES = ["", "src/", "app/", "lib/", "pkg/", "src/main/java/", "include/"]


def file_bases(files: DataFrame) -> DataFrame:
    """(base, file, suffix_rank): every module path that means a file. A file has few: those whose suffix it ends with.

    Turning the probe around (strip suffixes from files once instead of adding each of them to every
    import) makes the lookup an equi-join.
    """
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), F.when(F.endswith(F.col("path"), F.lit(s)), F.expr(f"substring(path, 1, length(path) - {len(s)})")).alias("base")) for i, s in enumerate(SUFFIXES)]), lambda x: x["base"].isNotNull() & (x["base"] != ""))
    return files.select("path", F.explode(hits).alias("h")).select(F.col("h.base").alias("base"), F.col("path").alias("file"), F.col("h.rank").alias("suffix_rank"))


def _first_file(candidates: DataFrame, bases: DataFrame, key: list[str]) -> DataFrame:
    """For each import the file of the first base, then the first suffix."""
    best = candidates.join(bases, "base").groupBy(*key).agg(F.min(F.struct("base_rank", "suffix_rank", "file")).alias("m"))
    return best.select(*key, F.col("m.file").alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, go_modules: DataFrame | None = None) -> DataFrame:
    """IMPORTS edges (paths, not ids): source_file, target, imported_names, spec.

    ``imports``: source_file, module_spec, names array<string>, is_relative. ``files``: path.
    ``aliases``: prefix, target (path mappings; the longest matching prefix wins). ``go_modules``:
    module, dir (the longest matching module wins); a Go import means every Go file of the package
    folder but tests. Specs that lead to no file, and files that import themselves, give no edge; names of
    all specs between two files are merged, sorted and distinct; the smallest spec stands for them.
    """
    files = files.select("path").filter("path IS NOT NULL").distinct()
    bases = file_bases(files)
    imp = imports.filter("source_file IS NOT NULL AND module_spec IS NOT NULL").select("source_file", "module_spec", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("is_relative", F.lit(False)).alias("is_relative"))
    src, spec = F.col("source_file"), F.col("module_spec")
    folder = F.regexp_extract(src, "^(.*)/[^/]*$", 1)
    ends = lambda *xs: F.regexp_extract(src, r"(\.[^.]*)$", 1).isin(*xs)
    python, go = ends(".py"), ends(".go")

    # relative: climb and descend from the folder of the file
    dots = F.length(spec) - F.length(F.ltrim(spec, F.lit(".")))
    up = F.concat(folder, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))), F.lit("/"), F.translate(F.ltrim(spec, F.lit(".")), ".", "/"))
    relative = F.when(python, clean(up)).when(folder == "", spec).otherwise(clean(F.concat(folder, F.lit("/"), spec)))
    # absolute: the separator of the language becomes a slash, then source folders are tried
    module = (F.when(python | ends(".java", ".kt", ".kts", ".cs"), F.translate(spec, ".", "/"))
              .when(ends(".php"), F.translate(F.trim(spec, F.lit("\\")), "\\", "/"))
              .when(ends(".rs"), F.regexp_replace(F.replace(spec, F.lit("::"), F.lit("/")), "^(?:crate/)?(?:super/)?", ""))
              .when(ends(".c", ".cpp", ".cc", ".h", ".hpp"), F.regexp_replace(spec, "^include/", "")).otherwise(spec))
    absolute = F.array(*[F.struct(F.lit(i + 1).alias("base_rank"), F.concat(F.lit(p), module).alias("base")) for i, p in enumerate(PREFIXES)])
    plain = imp.filter(~go).withColumn("_bases", F.when(F.col("is_relative"), F.array(F.struct(F.lit(1).alias("base_rank"), relative.alias("base")))).otherwise(absolute))
    if aliases is not None:
        hit = imp.filter(~go & ~F.col("is_relative")).select("source_file", "module_spec").distinct().join(F.broadcast(aliases.select("prefix", F.col("target").alias("_to"))), F.startswith(spec, F.col("prefix")))  # a few lines of configuration
        best = hit.groupBy("source_file", "module_spec").agg(F.max_by(F.struct("prefix", "_to"), F.length("prefix")).alias("a"))
        plain = plain.join(best, ["source_file", "module_spec"], "left")
        aliased = F.when(F.col("a").isNotNull(), F.array(F.struct(F.lit(0).alias("base_rank"), F.concat(F.col("a._to"), F.expr("substring(module_spec, length(a.prefix) + 1)")).alias("base"))))
        plain = plain.withColumn("_bases", F.concat(F.coalesce(aliased, F.array().cast("array<struct<base_rank:int,base:string>>")), "_bases")).drop("a")
    exploded = plain.select("source_file", "module_spec", "names", F.explode("_bases").alias("b")).select("source_file", "module_spec", "names", F.col("b.base_rank").alias("base_rank"), F.col("b.base").alias("base")).filter("base <> ''")
    key = ["source_file", "module_spec"]
    found = _first_file(exploded.select(*key, "base_rank", "base").distinct(), bases, key)
    out = plain.select(*key, "names").join(found, key)
    # from package import module: every name may be a file below any of the bases
    named = exploded.filter(F.endswith("source_file", F.lit(".py"))).select(*key, "base_rank", "base", F.explode("names").alias("_n"), "names")
    named = named.select(*key, "names", F.col("base_rank"), "_n", clean(F.concat("base", F.lit("/"), "_n")).alias("base"))
    below = _first_file(named.select(*key, "base_rank", "_n", "base"), bases, [*key, "base_rank", "_n"])
    out = out.unionByName(named.select(*key, "names").join(below.select(*key, "target"), key))
    if go_modules is not None:
        # every leading part of a spec may be a module, so this is a join by equality
        parts = F.split(spec, "/")
        g = imp.filter(go).withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
        g = g.join(go_modules.select("module", F.col("dir").alias("_dir")), "module")
        best = g.groupBy("source_file", "module_spec", "names").agg(F.max_by(F.struct("module", "_dir"), F.length("module")).alias("m"))
        sub = F.ltrim(F.expr("substring(module_spec, length(m.module) + 1)"), F.lit("/"))
        best = best.withColumn("package", F.array_join(F.filter(F.array(F.col("m._dir"), sub), lambda x: x != ""), "/"))
        go_files = files.filter(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select(F.col("path").alias("target"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("package"))
        hits = best.join(go_files, "package").filter(F.regexp_extract("source_file", "^(.*)/[^/]*$", 1) != F.col("package"))
        out = out.unionByName(hits.select(*key, "names", "target"))
    return (out.filter("target <> source_file").groupBy("source_file", "target")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("imported_names"), F.min("module_spec").alias("spec")))


def _unique(symbols: DataFrame, *keys: str) -> DataFrame:
    """Per key: number of symbols, smallest and largest id. Two ids tell which one is left when a caller is left out."""
    return symbols.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def _others(prefix: str, own: Column) -> tuple[Column, Column]:
    """Candidates other than the caller, and the only one if one remains. ``own``: the caller is among them."""
    n = F.coalesce(F.col(f"{prefix}n"), F.lit(0)) - own.cast("int")
    return n, F.when(F.col(f"{prefix}lo") == F.col("caller_id"), F.col(f"{prefix}hi")).otherwise(F.col(f"{prefix}lo"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS edges (src, dst) from (caller_id, called_name).

    Candidates are the symbols of that short name other than the caller. Any in the caller's file: the
    only one in the caller's class, else the only one in the file, else none. Otherwise the only one
    in the files the caller's file imports, else the only one anywhere. Ambiguous calls, unknown
    callers and unknown names give no edge; repeated calls one. ``imports``: source_file, target (paths).

    A name that a tenth of all calls use is one row on the side it is joined to, and its calls are
    split over salts.
    """
    sym = symbols.select("id", short_name(F.col("name")).alias("short"), "file_path", F.when(F.startswith("parent_id", F.lit("class:")), F.col("parent_id")).alias("class_id")).filter("short <> ''")
    named, in_file, in_class = _unique(sym, "short"), _unique(sym, "file_path", "short"), _unique(sym.filter("class_id IS NOT NULL"), "file_path", "class_id", "short")
    pre = lambda df, p, *keys: df.select(*keys, *[F.col(c).alias(p + c) for c in ("n", "lo", "hi")])
    asked = calls.select("caller_id", F.col("called_name").alias("short")).filter("caller_id IS NOT NULL AND short <> ''").distinct()
    asked = asked.join(sym.select(F.col("id").alias("caller_id"), F.col("short").alias("own"), "file_path", "class_id"), "caller_id")
    asked = skew_join(asked, pre(named, "a_", "short"), ["short"], "inner", ["caller_id"])
    asked = asked.join(pre(in_file, "f_", "file_path", "short"), ["file_path", "short"], "left")
    asked = asked.join(pre(in_class, "c_", "file_path", "class_id", "short"), ["file_path", "class_id", "short"], "left")
    own = F.col("own") == F.col("short")
    n_all, id_all = _others("a_", own)
    n_file, id_file = _others("f_", own)
    n_class, id_class = _others("c_", own & F.col("class_id").isNotNull())
    asked = asked.select("caller_id", "short", "file_path", n_all.alias("n_all"), id_all.alias("id_all"), n_file.alias("n_file"), id_file.alias("id_file"), n_class.alias("n_class"), id_class.alias("id_class"))
    # only calls that leave the file look at imported files, each of which answers with one row
    away = asked.filter("n_file = 0 AND n_all > 0").select("caller_id", "short", "file_path")
    seen = imports.select(F.col("source_file").alias("file_path"), F.col("target").alias("_t")).filter("file_path <> _t").distinct()
    wanted = away.select("file_path", "short").distinct().join(seen, "file_path")
    there = wanted.join(in_file.select(F.col("file_path").alias("_t"), "short", "n", "lo"), ["_t", "short"]).groupBy("file_path", "short").agg(F.sum("n").alias("n_imp"), F.min("lo").alias("id_imp"))
    asked = asked.join(there, ["file_path", "short"], "left")
    target = (F.when(F.col("n_file") > 0, F.when(F.col("n_class") == 1, F.col("id_class")).when(F.col("n_file") == 1, F.col("id_file")))
              .when(F.col("n_imp") == 1, F.col("id_imp")).when(F.col("n_all") == 1, F.col("id_all")))
    return asked.select(F.col("caller_id").alias("src"), target.alias("dst")).filter("dst IS NOT NULL").distinct()


def resolve_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, handler_id): the symbol of a route's handler: the one of that id in the file, else the smallest of that name there."""
    sym = symbols.select("file_path", "id", "name")
    in_file = sym.select("file_path", "id", F.explode(F.array_distinct(F.array("name", short_name(F.col("name"))))).alias("handler_name")).groupBy("file_path", "handler_name").agg(
        F.min(F.struct((F.col("id") != F.concat(F.lit("symbol:"), "file_path", F.lit(":"), "handler_name")).alias("p"), "id")).alias("m"))
    return routes.select("id", "file_path", "handler_name").join(in_file, ["file_path", "handler_name"]).select("id", F.col("m.id").alias("handler_id"))


def table_imports(nodes: DataFrame) -> DataFrame:
    """Resolved imports of module nodes whose ``import_paths`` are module paths: source_file, target, imported_names, spec."""
    modules = nodes.filter("level = 'L1'")
    specs = modules.select(F.col("path").alias("source_file"), F.explode("import_paths").alias("base")).filter("base <> ''").distinct()
    hits = _first_file(specs.withColumn("base_rank", F.lit(0)).withColumn("module_spec", F.col("base")), file_bases(modules.select("path").filter("path <> ''")), ["source_file", "module_spec"])
    return hits.filter("target <> source_file").groupBy("source_file", "target").agg(F.first(F.array().cast("array<string>")).alias("imported_names"), F.min("module_spec").alias("spec"))


def table_edges(nodes: DataFrame) -> DataFrame:
    """All edges of table nodes, those without an end left out."""
    level = lambda x: nodes.filter(F.col("level") == x)
    file_id = lambda c: F.concat(F.lit("file:"), c)
    contains = (level("L1").filter("domain <> ''").select(F.concat(F.lit("domain:"), "domain").alias("src"), F.col("id").alias("dst"))
                .unionByName(nodes.filter("level IN ('L2', 'Route') AND file_path <> ''").select(file_id(F.col("file_path")).alias("src"), F.col("id").alias("dst")))
                .unionByName(level("L3").filter("parent_id <> ''").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))))
    imports = table_imports(nodes)
    calls = resolve_calls(level("L3").select(F.col("id").alias("caller_id"), F.explode("calls").alias("called_name")), level("L3"), imports)
    handled = level("Route").filter("handler_symbol <> ''").select("id", F.col("handler_symbol").alias("handler"))
    edges = as_edges(contains.withColumn("edge_type", F.lit(CONTAINS)))
    edges = edges.unionByName(as_edges(imports.select(file_id(F.col("source_file")).alias("src"), file_id(F.col("target")).alias("dst"), F.lit(IMPORTS).alias("edge_type"), "imported_names", "spec")))
    edges = edges.unionByName(as_edges(calls.withColumn("edge_type", F.lit(CALLS))))
    edges = edges.unionByName(as_edges(handled.select(F.col("id").alias("src"), F.col("handler").alias("dst"), F.lit(HANDLED_BY).alias("edge_type"))))
    edges = edges.unionByName(as_edges(handled.select(F.col("handler").alias("src"), F.col("id").alias("dst"), F.lit(EXPOSES_ROUTE).alias("edge_type"))))
    ids = nodes.select("id")
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
