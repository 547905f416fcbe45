"""Schemas of the code graph's tables and of the extractor's output."""

FILES = "id long, path string, hash string, lang string, indexed_at long, size long, modified_ns long"
SYMBOLS = "id long, file_id long, name string, kind string, line_start long, line_end long, parent_id long, visibility string, signature string, is_test int"
REFS = "id long, source_file_id long, source_symbol_id long, target_symbol_id long, kind string, target_name string, target_qualifier string, line long, resolved boolean"
IMPORTS = "id long, file_id long, local_name string, full_path string, alias string, line long"
SOURCES = "path string, content string"

EXTRACTED = (
    "symbols array<struct<name:string,kind:string,line_start:long,line_end:long,parent_name:string,visibility:string,signature:string,is_test:boolean>>, "
    "refs array<struct<kind:string,target_name:string,target_qualifier:string,line:long,source_symbol_name:string>>, "
    "imports array<struct<local_name:string,full_path:string,alias:string,line:long>>"
)

#: Fixed values of the data model.
EXTENSIONS = {"php": "php", "rs": "rust", "py": "python", "js": "typescript", "jsx": "typescript", "ts": "typescript", "tsx": "typescript", "qml": "qml"}
ENTRY_POINTS = ("main", "new", "__init__", "__construct")
INHERITANCE = ("inherit", "implement", "trait_impl")
TYPES = ("class", "struct", "trait", "interface")
TOP_LEVEL = "<top-level>"
