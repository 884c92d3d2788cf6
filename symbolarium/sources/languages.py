"""The language dimension: what files are in a language, and how its definitions and calls look.

The rows are a parameter of every operator that uses them. Each language has its own
reserved words; pass ``keywords`` for others.
"""

from __future__ import annotations

import keyword
from dataclasses import dataclass

_C = ("//",), ("/*",)
_CALL = (r"\b(\w+)\s*\(",)
_JS = (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(")

#: Reserved words, which are no names, by language.
RESERVED = {
    "go": (
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type "
        "var"
    ),
    "javascript jsx": (
        "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof "
        "let new of return set static super switch throw try typeof var void while with yield"
    ),
    "typescript tsx": (
        "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof "
        "let new of return set static super switch throw try typeof var void while with yield"
    ),
    "rust": (
        "Self as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static "
        "struct super trait true type union unsafe use where while yield"
    ),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements "
        "import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw "
        "throws transient try void volatile while"
    ),
    "kotlin": (
        "abstract actual as break by catch class companion const constructor continue crossinline data delegate do dynamic else enum expect external false "
        "final finally for fun get if import in infix init inline inner interface internal is it lateinit noinline null object open operator out override "
        "package private protected public reified return sealed set super suspend tailrec this throw true try typealias typeof val var vararg when where while"
    ),
    "swift": (
        "Self as associatedtype break case catch class continue default defer deinit do else enum extension fallthrough false fileprivate final for func guard "
        "if import in init inout internal is lazy let mutating nil open operator override private protocol public repeat required rethrows return self static "
        "struct subscript super switch throw throws true try typealias unowned var weak where while"
    ),
    "csharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false "
        "finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private "
        "protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked "
        "unsafe ushort using virtual void volatile while"
    ),
    "ruby": (
        "BEGIN END alias and begin break case class def defined? do else elsif end ensure extend fail false for if in include lambda module next nil not or p "
        "print proc puts raise redo require require_relative rescue retry return self super then true undef unless until when while yield"
    ),
    "php": (
        "abstract and array as break callable case catch class clone const continue declare default die do echo else elseif empty enddeclare endfor endforeach "
        "endif endswitch endwhile eval exit extends final finally for foreach function global goto if implements include include_once instanceof insteadof "
        "interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset "
        "use var while xor yield"
    ),
    "c": (
        "auto break case char const continue default do double else enum extern float for goto if int long register return short signed sizeof static struct "
        "switch typedef union unsigned void volatile while"
    ),
    "cpp header": (
        "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t char8_t class co_await co_return co_yield compl concept "
        "const const_cast consteval constexpr constinit continue decltype default delete do double dynamic_cast else enum explicit export extern false float "
        "for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register "
        "reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef "
        "typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq"
    ),
    "scala": (
        "abstract case catch class def do else extends false final finally for forSome if implicit import lazy match new null object override package private "
        "protected return sealed super this throw trait true try type val var while with yield"
    ),
    "lua": (
        "and break do else elseif end false for function goto if in local nil not or print repeat require return then true until while"
    ),
    "shell": (
        "break case continue declare do done echo elif else esac exec exit export false fi for function if local printf read readonly return set shift source "
        "test then true unset while"
    ),
    "haskell": (
        "case class data default deriving do else forall foreign if import in infix infixl infixr instance let module newtype of then type where"
    ),
    "elixir": (
        "after and case catch cond def defexception defmacro defmodule defp defprotocol defstruct do else end false fn for if import in nil not or quote raise "
        "receive require rescue return super throw true try unless unquote use when with"
    ),
    "r": (
        "FALSE Inf NA NULL NaN TRUE break else for function if in library next repeat require return while"
    ),
    "julia": (
        "abstract baremodule begin break catch const continue do else elseif end export false finally for function global if import in let local macro module "
        "mutable primitive quote return struct true try type using where while"
    ),
    "dart": (
        "Function abstract as assert async await break case catch class const continue covariant default deferred do dynamic else enum export extends extension "
        "external factory false final finally for get hide if implements import in inout interface is late library mixin new null on operator part required "
        "rethrow return sealed set show static super switch sync this throw true try typedef var void when while with yield"
    ),
    "perl": (
        "die do else elsif exit for foreach if last local my next no our pop print push redo require return say shift splice sub unless unshift until use warn "
        "while"
    ),
    "nim": (
        "addr and as asm bind block break case cast concept const continue converter defer discard distinct div do elif else end enum except export finally for "
        "from func if import in include interface is isnot iterator let macro method mixin mod nil not notin object of or out proc ptr raise ref return shl shr "
        "static template try tuple type using var when while xor yield"
    ),
    "zig": (
        "addrspace align allowzero and anyframe anytype asm async await break callconv catch comptime const continue defer else enum errdefer error export "
        "extern false fn for if inline linksection noalias noinline nosuspend null opaque or orelse packed pub resume return struct suspend switch test "
        "threadlocal true try type undefined union unreachable usingnamespace var volatile while"
    ),
    "clojure": (
        "and case catch cond def defmacro defmethod defmulti defn defn- defprotocol defrecord defstruct deftype do doseq dotimes false finally fn for if import "
        "let loop new nil not ns or recur require this throw true try use when while"
    ),
    "erlang": (
        "after and andalso band begin bnot bor bsl bsr bxor case catch cond div end fun if let not of or orelse query receive rem try when xor"
    ),
    "ocaml": (
        "and as asr assert begin class constraint do done downto else end exception external false for fun function functor if in include inherit initializer "
        "land lazy let lor lsl lsr lxor match method mod module mutable new nonrec object of open or private rec sig struct then to true try type val virtual "
        "when while with"
    ),
    "fsharp": (
        "abstract and as assert base begin class default delegate do done downcast downto elif else end exception extern false finally fixed for fun function "
        "global if in inherit inline interface internal lazy let match member module mutable namespace new not null of open or override private public rec "
        "return sig static struct then to true try type upcast use val virtual void when while with yield"
    ),
    "sql": (
        "ALL ALTER AND AS BEGIN BY CASE COMMIT CREATE DATABASE DELETE DISTINCT DROP ELSE END FROM FULL GROUP HAVING IN INDEX INNER INSERT INTO IS JOIN LEFT "
        "LIMIT NOT NULL OFFSET ON OR ORDER OUTER RETURNING RIGHT ROLLBACK SCHEMA SELECT SET TABLE THEN UNION UPDATE VALUES VIEW WHEN WHERE WITH"
    ),
    "matlab": (
        "break case catch classdef continue else elseif end for function global if otherwise parfor persistent return spmd switch try while"
    ),
}
_WORDS = {i: tuple(w.split()) for ids, w in RESERVED.items() for i in ids.split()}


@dataclass(frozen=True)
class Language:
    id: str
    extensions: tuple[str, ...]
    functions: tuple[str, ...]
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    calls: tuple[str, ...] = _CALL
    shebangs: tuple[str, ...] = ()
    tier: str = "lexical"
    keywords: tuple[str, ...] = ()


def _language(id_: str, extensions: str, functions: tuple[str, ...], comments: tuple = _C, **more) -> Language:
    return Language(id_, tuple(extensions.split()), functions, *comments, **{"keywords": _WORDS.get(id_, ("",)), **more})  # the empty word, which is no name, where none is reserved


# Extensions, comment marks, patterns and tiers of the languages.
LANGUAGES = [
    _language("go", ".go", (r"func\s+(\w+)\s*\(", r"func\s+\(\w+\s+\*?\w+\)\s+(\w+)\s*\("), tier="ast"),
    _language("javascript", ".js .mjs .cjs", _JS, shebangs=("node",)),
    _language("typescript", ".ts .mts .cts", _JS, shebangs=("ts-node",)),
    _language("jsx", ".jsx", _JS),
    _language("tsx", ".tsx", _JS),
    _language(
        "python", ".py .pyw", (r"(?:async\s+)?def\s+(\w+)\s*\(",), (("#",), ('"""',)), shebangs=("python", "python2", "python3"),
        keywords=tuple(k for k in [*keyword.kwlist, "print", "exec", "type"] if k[0].islower()),
    ),
    _language(
        "rust", ".rs", (r"(?:pub\s+)?(?:pub\s*\([^)]*\)\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)\s*[<(]",),
        types=(r"(?:pub\s+)?const\s+(\w+)\s*:", r"(?:pub\s+)?static\s+(?:mut\s+)?(\w+)\s*:", r"(?:pub\s+)?(?:struct|enum|trait|union|type)\s+(\w+)\s*[<{;]"),
    ),
    _language("java", ".java", (r"(?:(?:public|private|protected|static|final|synchronized|abstract|native|strictfp)\s+)+[\w<>\[\],\s]+\s+(\w+)\s*\(",)),
    _language("kotlin", ".kt .kts", (r"(?:(?:private|public|internal|protected|open|override|inline|suspend|operator|infix|tailrec)\s+)*fun\s+(\w+)\s*[<(]",)),
    _language("swift", ".swift", (r"(?:(?:public|private|internal|open|fileprivate|override|static|class|mutating|nonmutating|final|required)\s+)*func\s+(\w+)\s*[<(]",)),
    _language(
        "csharp", ".cs",
        (r"(?:(?:public|private|protected|internal|static|virtual|abstract|override|sealed|async|new|partial|extern|unsafe)\s+)+[\w<>\[\],\s]+\s+(\w+)\s*\(",),
    ),
    _language("ruby", ".rb .rake .ru", (r"def\s+(\w+[?!]?)",), (("#",), ("=begin",)), shebangs=("ruby",)),
    _language("php", ".php .phtml", (r"(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(\w+)\s*\(",), (("//", "#"), ("/*",))),
    _language("c", ".c", (r"^\w[\w\s\*]*\s(\w+)\s*\([^)]*\)\s*\{",), tier="regex"),
    _language("cpp", ".cpp .cc .cxx .c++", (r"^\w[\w\s\*:<>]*\s(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{",), tier="regex"),
    _language("header", ".h .hpp .hxx", (r"^\w[\w\s\*:<>]*\s(\w+)\s*\([^)]*\)\s*;",), tier="regex"),
    _language("scala", ".scala .sc", (r"(?:(?:private|public|protected|override|implicit|final|abstract|lazy|sealed)\s+)*def\s+(\w+)\s*[(\[]",)),
    _language("lua", ".lua", (r"(?:local\s+)?function\s+(\w+)\s*\(", r"(\w+)\s*=\s*function\s*\("), (("--",), ("--[[",))),
    _language("shell", ".sh .bash .zsh .ksh .fish", (r"(?:function\s+)?(\w+)\s*\(\s*\)\s*\{",), (("#",), ()), calls=(r"\b(\w+)\b",), shebangs=("sh", "bash", "zsh", "fish"), tier="regex"),
    _language("haskell", ".hs .lhs", (r"^(\w+)\s+::",), (("--",), ("{-",)), tier="regex"),
    _language("elixir", ".ex .exs", (r"defp?\s+(\w+[?!]?)",), (("#",), ())),
    _language("r", ".r", (r"(\w+)\s*<-\s*function\s*\(",), (("#",), ()), tier="regex"),
    _language("julia", ".jl", (r"function\s+(\w+)\s*\(", r"(\w+)\s*\([^)]*\)\s*="), (("#",), ("#=",))),
    _language("dart", ".dart", (r"(?:(?:static|async|external|factory|const|final)\s+)*\w[\w<>\[\]? ]*\s+(\w+)\s*\(",)),
    _language("perl", ".pl .pm .perl", (r"sub\s+(\w+)\s*[{(]",), (("#",), ()), shebangs=("perl",), tier="regex"),
    _language("nim", ".nim", (r"(?:proc|func|method|template|macro|iterator)\s+(\w+)\s*[(*]",), (("#",), ())),
    _language("zig", ".zig", (r"(?:pub\s+)?fn\s+(\w+)\s*\(",), (("//",), ())),
    _language("clojure", ".clj .cljs .cljc .edn", (r"\(defn-?\s+([\w\-?!.*+/<>=]+)\s",), ((";",), ()), calls=(r"\(([\w\-?!.*+/<>=]+)\s",)),
    _language("erlang", ".erl .hrl", (r"^(\w+)\s*\([^)]*\)\s*->",), (("%",), ())),
    _language("ocaml", ".ml .mli", (r"(?:let|and)\s+(?:rec\s+)?(\w+)\s+[^=]*=",), ((), ("(*",)), tier="regex"),
    _language("fsharp", ".fs .fsi .fsx", (r"(?:let|and)\s+(?:rec\s+)?(?:inline\s+)?(\w+)\s+[^=]*=",), (("//",), ("(*",)), tier="regex"),
    _language("sql", ".sql", (r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+(\w+)\s*\(",), (("--",), ("/*",)), tier="regex"),
    _language("matlab", ".m", (r"function\s+(?:[\w,\[\]\s]*=\s*)?(\w+)\s*\(",), (("%",), ()), tier="regex"),
    _language("terraform", ".tf .tfvars", (r'resource\s+"[^"]+"\s+"(\w+)"\s*\{', r'module\s+"(\w+)"\s*\{'), (("//", "#"), ("/*",)), calls=(), tier="regex"),
]
#: Confidence of what a tier finds.
CONFIDENCE = {"ast": 1.0, "lexical": 0.8, "regex": 0.6}
