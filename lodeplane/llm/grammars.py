"""Grammars of the source languages, written after their public specifications, and the token tables that go with them.

They describe whole files. Where a specification forbids by prose what its grammar would allow (names and types), these
grammars are as wide as the syntax; only syntax counts here. Targets of assignments, the order of parameters and
arguments, and expressions that are no statements are told apart by rules of their own. ``NL`` in JavaScript and
TypeScript is a line end that may either be skipped or close a statement; in Python it ends a logical line.
"""

from __future__ import annotations

PYTHON = r"""
file = { NL | stmt } EOF ;
stmt = simple | compound ;
simple = small { ';' small } [ ';' ] NL ;
block = simple | NL INDENT stmt { stmt } DEDENT ;
name = NAME | 'match' | 'case' | 'type' | '_' ;
small = exprstmt | 'return' [ starlist ] | 'import' dotas { ',' dotas } | 'from' from | 'raise' [ expr [ 'from' expr ] ] | 'pass' | 'break' | 'continue'
  | 'del' ltarget { ',' ltarget } [ ',' ] | 'assert' expr [ ',' expr ] | ( 'global' | 'nonlocal' ) name { ',' name } | 'type' name [ tparams ] '=' expr ;
from = ( { '.' | '...' } dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | '(' as { ',' as } [ ',' ] ')' | as { ',' as } ) ;
dotted = name { '.' name } ;
dotas = dotted [ 'as' name ] ;
as = name [ 'as' name ] ;
exprstmt = starlist | yield | assigned | single ( AUG ( yield | starlist ) | ':' expr [ '=' ( yield | starlist ) ] ) ;
assigned = lhs '=' ( yield | starlist | assigned ) ;
lhs = [ '*' ] ltarget { ',' [ '*' ] ltarget } [ ',' ] ;
ltarget = name | ltail | '(' [ lhs ] ')' | '[' [ lhs ] ']' ;
single = name | ltail | '(' single ')' ;
ltail = [ 'await' ] atom { trailer } ( '.' name | '[' subs ']' ) ;
yield = 'yield' ( 'from' expr | [ starlist ] ) ;
starlist = staritem { ',' staritem } [ ',' ] ;
staritem = '*' bitor | named ;
named = name ':=' expr | expr ;
expr = 'lambda' [ @LAMBDA@ ] ':' expr | or [ 'if' or 'else' expr ] ;
or = and { 'or' and } ;
and = not { 'and' not } ;
not = { 'not' } compare ;
compare = bitor { ( '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' [ 'not' ] ) bitor } ;
bitor = unary { ( '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' ) unary } ;
unary = { '+' | '-' | '~' } power ;
power = [ 'await' ] atom { trailer } [ '**' unary ] ;
trailer = '(' [ args | named comp ] ')' | '[' subs ']' | '.' name ;
str = STR | FSTART { ( yield | starexprs ) [ '=' ] FFIELD } FEND ;
atom = name | NUM | str { str } | '...' | 'None' | 'True' | 'False' | '(' [ yield | starexprs comp | starexprs ] ')' | '[' [ starexprs | staritem comp ] ']' | '{' [ dict | set ] '}' ;
starexprs = staritem { ',' staritem } [ ',' ] ;
dict = pair ( comp | { ',' pair } [ ',' ] ) ;
pair = expr ':' expr | '**' bitor ;
set = staritem ( comp | { ',' staritem } [ ',' ] ) ;
comp = compfor { compfor | 'if' ornamed } ;
compfor = [ 'async' ] 'for' targets 'in' or ;
ornamed = or | name ':=' or ;
targets = tgt { ',' tgt } [ ',' ] ;
tgt = [ '*' ] ltarget ;
args = ( named | '*' expr ) [ ',' [ args ] ] | kargs ;
kargs = name '=' expr [ ',' [ kargs ] ] | '*' expr [ ',' [ kargs ] ] | '**' expr [ ',' [ dargs ] ] ;
dargs = name '=' expr [ ',' [ dargs ] ] | '**' expr [ ',' [ dargs ] ] ;
subs = sub { ',' sub } [ ',' ] ;
sub = [ expr ] ':' [ expr ] [ ':' [ expr ] ] | named | '*' bitor ;
@PARAMETERS@
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = name [ ':' expr ] [ '=' expr ] | ( '*' | '**' ) name [ '=' expr ] ;
compound = if | while | for | try | with | def | class | decorated | 'async' ( def | with | for ) | match ;
if = 'if' named ':' block { 'elif' named ':' block } [ 'else' ':' block ] ;
while = 'while' named ':' block [ 'else' ':' block ] ;
for = 'for' targets 'in' starlist ':' block [ 'else' ':' block ] ;
try = 'try' ':' block ( 'finally' ':' block | except { except } [ 'else' ':' block ] [ 'finally' ':' block ] ) ;
except = 'except' [ '*' ] [ expr [ 'as' name ] ] ':' block ;
with = 'with' ( item { ',' item } | '(' item { ',' item } [ ',' ] ')' ) ':' block ;
item = expr [ 'as' tgt ] ;
def = 'def' name [ tparams ] '(' [ @DEF@ ] ')' [ '->' expr ] ':' block ;
class = 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' block ;
decorated = '@' named NL { '@' named NL } ( def | class | 'async' def ) ;
match = 'match' starlist ':' NL INDENT case { case } DEDENT ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = aspat { ',' aspat } [ ',' ] ;
aspat = orpat [ 'as' name ] | '*' name ;
orpat = pat { '|' pat } ;
pat = [ '-' ] NUM [ ( '+' | '-' ) NUM ] | STR { STR } | 'None' | 'True' | 'False' | dotted [ '(' [ kpat { ',' kpat } [ ',' ] ] ')' ] | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ mpat { ',' mpat } [ ',' ] ] '}' ;
kpat = [ name '=' ] aspat ;
mpat = pat ':' aspat | '**' name ;
"""


def _parameters(rule: str, note: str, star_note: str) -> str:
    """Rules for a list of parameters: those without a default first, at most one ``/``, then ``*``, then names, then ``**``."""
    p = rule
    return f"""{p} = {p}a | {p}d | {p}s ;
{p}n = name {note} ;
{p}v = {p}n '=' expr ;
{p}a = {p}n [ ',' [ {p}a | '/' [ ',' [ {p}b | {p}e | {p}s ] ] | {p}d | {p}s ] ] ;
{p}b = {p}n [ ',' [ {p}b | {p}e | {p}s ] ] ;
{p}d = {p}v [ ',' [ {p}d | '/' [ ',' [ {p}e | {p}s ] ] | {p}s ] ] ;
{p}e = {p}v [ ',' [ {p}e | {p}s ] ] ;
{p}s = '*' name {star_note} [ ',' [ {p}k ] ] | '*' ',' {p}w | {p}x ;
{p}k = {p}w | {p}x ;
{p}w = ( {p}n | {p}v ) [ ',' [ {p}k ] ] ;
{p}x = '**' name {note} [ ',' ] ;
"""


PYTHON = PYTHON.replace("@LAMBDA@", "lparams").replace("@DEF@", "params").replace("@PARAMETERS@", _parameters("params", "[ ':' expr ]", "[ ':' staritem ]") + _parameters("lparams", "", ""))

JSON = r"""
file = value EOF ;
value = STR | NUM | 'true' | 'false' | 'null' | '{' [ STR ':' value { ',' STR ':' value } ] '}' | '[' [ value { ',' value } ] ']' ;
"""

_WORDS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
_SOFT_JS = "as async await from get let of set static yield"
_SOFT_TS = _SOFT_JS + " abstract any asserts boolean declare infer interface is keyof module namespace never number object out override private protected public readonly require string symbol type undefined unique unknown using satisfies accessor global implements bigint"


def _any(words: str) -> str:
    return " | ".join(f"'{w}'" for w in words.split())


# Parts in doubled braces differ between JavaScript and TypeScript.
_ECMA = r"""
file = { item } [ opened ] EOF ;
item = stmt ;
eos = ';' | NL ;
stmt = closed | simple eos ;
list = { stmt } [ opened ] ;
block = '{' list '}' ;
ident = NAME | @SOFT@ ;
nameany = ident | @WORDS@ ;
opened = simple | 'if' '(' expr ')' ( opened | stmt 'else' opened ) | 'while' '(' expr ')' opened | forhead opened | ident ':' opened ;
closed = ';' | block | if | 'while' '(' expr ')' stmt | forhead stmt | 'with' '(' expr ')' stmt | switch | try | fun | class | ident ':' stmt | 'do' stmt 'while' '(' expr ')' [ ';' ] | 'export' exported @CLOSED@ ;
exported = ( fun | class | 'default' ( fundefault | classdefault ) @EXPORTED@ ) ;
simple = vars | <expr ! '{' 'function' 'class'> | 'return' [ expr ] | 'break' [ ident ] | 'continue' [ ident ] | 'throw' expr | 'debugger' | import | 'export' export @SIMPLE@ ;
import = 'import' ( STR | @TYPEONLY@ clause 'from' STR ) [ 'with' object ] ;
clause = ident [ ',' ( star | named ) ] | star | named ;
star = '*' 'as' ident ;
named = '{' [ spec { ',' spec } [ ',' ] ] '}' ;
spec = @TYPEONLY@ ( nameany | STR ) [ 'as' ( nameany | STR ) ] ;
export = @TYPEONLY@ ( '*' [ 'as' ( nameany | STR ) ] 'from' STR | named [ 'from' STR ] ) [ 'with' object ] | vars | 'default' <assign ! 'function' 'class'> @EXPORT@ ;
vars = 'var' decl { ',' decl } | 'let' <decl ! 'let'> { ',' <decl ! 'let'> } | 'const' <cdecl ! 'let'> { ',' <cdecl ! 'let'> } ;
decl = ident @DECLTYPE@ [ '=' assign ] | bpattern @DECLTYPE@ '=' assign @AMBIENT@ ;
cdecl = @CONST@ ;
if = 'if' '(' expr ')' stmt [ 'else' stmt ] ;
forhead = 'for' [ 'await' ] '(' ( [ vars | <expr ! 'let' > ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) pattern | lhs ) ( 'in' expr | 'of' assign ) ) ')' ;
switch = 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' list } '}' ;
try = 'try' block ( 'catch' [ '(' pattern @DECLTYPE@ ')' ] block [ 'finally' block ] | 'finally' block ) ;
expr = assign { ',' assign } ;
assign = arrow | 'yield' [ [ '*' ] assign ] | cond | lhs ( '=' | AUG @AUGS@ ) assign ;
lhs = ident | array | object | '(' expr ')' | { 'new' } primary { part } ( '.' ( nameany | PRIVATE ) | '[' expr ']' @LAST@ ) ;
arrow = [ 'async' ] ( ident | @TPARAMS@ '(' params ')' @RETTYPE@ ) '=>' ( block | <assign ! '{'> ) ;
cond = binary [ '?' assign ':' assign ] ;
binary = unary { ( BIN | '<' | '>' | 'in' | 'instanceof' | '+' | '-' | '*' | '/' @BINOPS@ ) unary } ;
unary = { '+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' @CAST@ } postfix ;
postfix = call [ '++' | '--' ] @POSTTYPE@ ;
call = { 'new' } primary { part } ;
part = '.' ( nameany | PRIVATE ) | '?.' ( nameany | PRIVATE | '[' expr ']' | '(' args ')' ) | '[' expr ']' | '(' args ')' | tpl @CALLS@ ;
args = [ [ '...' ] assign { ',' [ '...' ] assign } [ ',' ] ] ;
primary = ident | NUM | STR | REGEX | tpl | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE | '(' expr ')' | array | object | fun | fundefault | class | classdefault | 'import' ( '(' args ')' | '.' nameany ) | 'new' '.' nameany ;
tpl = TPL | TPLHEAD expr { TPLMID expr } TPLTAIL ;
array = '[' { ',' } [ elem { ',' [ elem ] } ] ']' ;
elem = [ '...' ] assign ;
object = '{' [ prop { ',' prop } [ ',' ] ] '}' ;
prop = '...' assign | key ':' assign | ident [ '=' assign ] | [ 'async' ] [ '*' ] key sig block | ( 'get' | 'set' ) key sig block ;
key = nameany | STR | NUM | '[' assign ']' | PRIVATE ;
sig = @TPARAMS@ '(' params ')' @RETTYPE@ ;
fun = [ 'async' ] 'function' [ '*' ] ident sig block ;
fundefault = [ 'async' ] 'function' [ '*' ] sig block ;
params = [ param { ',' param } [ ',' ] ] ;
param = @PARAMMODS@ [ '...' ] pattern @PARAMTYPE@ [ '=' assign ] @THIS@ ;
pattern = ident | bpattern ;
bpattern = '{' [ pprop { ',' pprop } [ ',' ] ] '}' | '[' { ',' } [ pelem { ',' [ pelem ] } ] ']' ;
pprop = '...' ident | key ':' pattern [ '=' assign ] | ident [ '=' assign ] ;
pelem = [ '...' ] pattern [ '=' assign ] ;
class = @DECORATORS@ 'class' ident classrest ;
classdefault = @DECORATORS@ 'class' classrest ;
classrest = @TPARAMS@ [ 'extends' call @HERITAGE@ ] @IMPLEMENTS@ '{' { member } [ field ] '}' ;
member = ';' | @DECORATORS@ { mod } ( [ 'async' ] [ '*' ] | 'get' | 'set' ) key @OPT@ sig block | 'static' block | field eos ;
mod = 'static' @MODS@ ;
field = @DECORATORS@ { mod } key @FIELDTYPE@ [ '=' assign ] @FIELDS@ ;
"""

_TYPES = r"""
type = ctype [ 'extends' ctype '?' type ':' type ] ;
ctype = [ 'abstract' ] [ 'new' ] [ tparams ] '(' params ')' '=>' rettype | union ;
union = [ '|' | '&' ] itype { ( '|' | '&' ) itype } ;
itype = { 'keyof' | 'unique' | 'readonly' | 'infer' } ptype ;
ptype = tbase { '[' [ type ] ']' } ;
tbase = ident { '.' nameany } [ targs ] | 'void' | 'null' | 'this' | 'true' | 'false' | STR | [ '-' ] NUM | tpltype | '(' type ')' | '[' [ telem { ',' telem } [ ',' ] ] ']' | objtype | 'typeof' ( ident | 'this' | 'import' '(' STR ')' ) { '.' nameany } [ targs ] | 'import' '(' STR ')' { '.' nameany } [ targs ] ;
tpltype = TPL | TPLHEAD type { TPLMID type } TPLTAIL ;
telem = [ '...' ] [ nameany [ '?' ] ':' ] type [ '?' ] ;
rettype = type | [ 'asserts' ] ( ident | 'this' ) 'is' type | 'asserts' ( ident | 'this' ) ;
targs = '<' type { ',' type } '>' ;
tparams = '<' tparam { ',' tparam } [ ',' ] '>' ;
tparam = { 'const' | 'in' | 'out' } ident [ 'extends' type ] [ '=' type ] ;
objtype = '{' { tmember ( ';' | ',' | NL ) } [ tmember ] '}' ;
tmember = [ [ '+' | '-' ] 'readonly' ] ( key [ '?' ] [ ':' type ] | '[' ident 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] [ ':' type ] | '[' ident ':' type ']' ':' type ) | [ 'get' | 'set' ] key [ '?' ] sig | [ 'new' ] sig ;
interface = 'interface' ident [ tparams ] [ 'extends' tbase { ',' tbase } ] objtype ;
namespace = ( ( 'namespace' | 'module' ) ( ident { '.' ident } | STR ) | 'global' ) block ;
enum = [ 'const' ] 'enum' ident '{' [ emember { ',' emember } [ ',' ] ] '}' ;
emember = ( nameany | STR ) [ '=' assign ] ;
decorator = '@' call ;
"""


def _fill(text: str, parts: dict[str, str]) -> str:
    for k, v in parts.items():
        text = text.replace(f"@{k}@", v)
    return text


_KEYS = "SOFT WORDS CLOSED EXPORTED SIMPLE TYPEONLY EXPORT DECLTYPE TPARAMS RETTYPE AUGS BINOPS POSTTYPE CAST CALLS PARAMMODS PARAMTYPE DECORATORS HERITAGE IMPLEMENTS OPT MODS FIELDTYPE FIELDS THIS LAST AMBIENT".split()
JAVASCRIPT = _fill(_ECMA, {k: "" for k in _KEYS} | {"CONST": "pattern '=' assign", "SOFT": _any(_SOFT_JS), "WORDS": _any(_WORDS)})
TYPESCRIPT = _fill(
    _ECMA,
    {
        "SOFT": _any(_SOFT_TS),
        "WORDS": _any(_WORDS),
        "CLOSED": "| interface | namespace | enum | 'declare' ( fun | class | interface | namespace | enum | 'abstract' class ) | 'abstract' class",
        "EXPORTED": "| interface | namespace | enum | 'abstract' class | 'default' ( interface | 'abstract' ( class | classdefault ) ) | 'declare' ( class | interface | namespace | enum | 'abstract' class )",
        "SIMPLE": "| 'type' ident [ tparams ] '=' type | 'declare' ( vars | 'type' ident [ tparams ] '=' type | [ 'async' ] 'function' ident sig ) | [ 'async' ] 'function' ident sig | 'import' [ 'type' ] ident '=' ( 'require' '(' STR ')' | ident { '.' ident } ) | ( 'module' | 'namespace' ) STR",
        "THIS": "| 'this' ':' type",
        "LAST": "| '!'",
        "AMBIENT": "| bpattern [ '!' ] ':' type",
        "CONST": "pattern @DECLTYPE@ [ '=' assign ]",
        "TYPEONLY": "[ 'type' ]",
        "EXPORT": "| 'type' ident [ tparams ] '=' type | 'declare' ( vars | 'function' ident sig ) | 'default' [ 'async' ] 'function' [ ident ] sig | [ 'async' ] 'function' ident sig | '=' assign | 'as' 'namespace' ident",
        "DECLTYPE": "[ [ '!' ] ':' type ]",
        "TPARAMS": "[ tparams ]",
        "RETTYPE": "[ ':' rettype ]",
        "AUGS": "| '>' '>' '=' | '>' '>' '>' '='",
        "BINOPS": "| '>' '>' | '>' '>' '>' | '>' '=' | '|' | '&'",
        "POSTTYPE": "{ ( 'as' | 'satisfies' ) ( type | 'const' ) }",
        "CAST": "| '<' ( type | 'const' ) '>'",
        "CALLS": "| '!' | targs",
        "PARAMMODS": "{ '@' call } { 'public' | 'private' | 'protected' | 'readonly' | 'override' }",
        "PARAMTYPE": "[ '?' ] [ ':' type ]",
        "DECORATORS": "{ decorator }",
        "HERITAGE": "",
        "IMPLEMENTS": "[ 'implements' tbase { ',' tbase } ]",
        "OPT": "[ '?' ]",
        "MODS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor'",
        "FIELDTYPE": "[ '?' | '!' ] [ ':' type ]",
        "FIELDS": "| { mod } ( 'get' | 'set' | [ '*' ] ) key [ '?' ] sig | { mod } '[' ident ':' type ']' ':' type",
    },
) + _TYPES

GO = r"""
file = 'package' NAME ';' { import ';' } { top ';' } EOF ;
import = 'import' ( spec | '(' [ spec { ';' spec } [ ';' ] ] ')' ) ;
spec = [ '.' | NAME ] STR ;
top = decl | 'func' NAME [ tparams ] signature [ block ] | 'func' params NAME signature [ block ] ;
decl = 'const' ( const | '(' [ const { ';' const } [ ';' ] ] ')' ) | 'var' ( var | '(' [ var { ';' var } [ ';' ] ] ')' ) | 'type' ( tspec | '(' [ tspec { ';' tspec } [ ';' ] ] ')' ) ;
const = names [ [ type ] '=' exprs ] ;
var = names ( type [ '=' exprs ] | '=' exprs ) ;
tspec = NAME [ tparams ] [ '=' ] type ;
names = NAME { ',' NAME } ;
exprs = expr { ',' expr } ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = names constraint ;
constraint = term { '|' term } ;
term = [ '~' ] type ;
type = NAME [ '.' NAME ] [ targs ] | '(' type ')' | '[' [ expr | '...' ] ']' type | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' | '*' type | 'func' signature | 'interface' '{' [ elem { ';' elem } [ ';' ] ] '}' | 'map' '[' type ']' type | [ '<-' ] 'chan' [ '<-' ] type ;
targs = '[' type { ',' type } [ ',' ] ']' ;
field = ( names type | [ '*' ] NAME [ '.' NAME ] [ targs ] ) [ STR ] ;
elem = NAME signature | constraint ;
signature = params [ params | type ] ;
params = '(' [ param { ',' param } [ ',' ] ] ')' ;
param = [ NAME ] [ '...' ] type ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = decl | NAME ':' [ stmt ] | simple | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough' | block | if | switch | select | for ;
simple = exprs [ ':=' exprs | ( '=' | AUG ) exprs | '++' | '--' | '<-' expr ] ;
if = 'if' [ simple ';' | ';' ] expr block [ 'else' ( if | block ) ] ;
switch = 'switch' [ [ simple ] ';' ] [ simple ] '{' { ( 'case' cases | 'default' ) ':' stmts } '}' ;
cases = casex { ',' casex } ;
casex = expr | type ;
select = 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
for = 'for' [ expr | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( ':=' | '=' ) ] 'range' expr ] block ;
expr = unary { ( BIN | '*' | '+' | '-' | '^' | '&' | '|' ) unary } ;
unary = { '+' | '-' | '!' | '^' | '*' | '&' | '<-' } primary ;
primary = operand { '.' ( NAME | '(' ( type | 'type' ) ')' ) | '[' index ']' | '(' [ arg { ',' arg } [ '...' ] [ ',' ] ] ')' | literal } ;
index = exprs [ ',' ] | [ expr ] ':' [ expr ] [ ':' expr ] | type { ',' type } [ ',' ] ;
arg = expr | type ;
operand = NUM | STR | CHAR | NAME | '(' ( expr | type ) ')' | 'func' signature block | ctype literal | convtype '(' expr [ ',' ] ')' ;
ctype = 'struct' '{' [ field { ';' field } [ ';' ] ] '}' | '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type ;
convtype = '[' ']' type | [ '<-' ] 'chan' [ '<-' ] type | 'map' '[' type ']' type | 'interface' '{' [ elem { ';' elem } [ ';' ] ] '}' ;
literal = '{' [ lelem { ',' lelem } [ ',' ] ] '}' ;
lelem = [ lval ':' ] lval ;
lval = expr | literal ;
"""

JAVA = r"""
file = [ package ] { importdecl | ';' } ( { typedecl | ';' } | [ annotations ] [ 'open' ] 'module' qname '{' { directive } '}' ) EOF ;
package = annotations 'package' qname ';' ;
directive = ( 'requires' { 'transitive' | 'static' } qname | ( 'exports' | 'opens' ) qname [ 'to' qname { ',' qname } ] | 'uses' qname | 'provides' qname 'with' qname { ',' qname } ) ';' ;
ident = NAME | 'open' | 'module' | 'requires' | 'transitive' | 'exports' | 'opens' | 'to' | 'uses' | 'provides' | 'with' | 'var' | 'record' | 'sealed' | 'permits' | 'yield' | 'when' | 'non' ;
qname = ident { '.' ident } ;
importdecl = 'import' [ 'static' | 'module' ] qname [ '.' '*' ] ';' ;
annotations = { annotation } ;
annotation = '@' qname [ '(' [ evals | epair { ',' epair } ] ')' ] ;
epair = ident '=' eval ;
evals = eval ;
eval = cond | annotation | '{' [ eval { ',' eval } ] [ ',' ] '}' ;
mods = { annotation | MOD | 'static' | 'default' | 'sealed' | 'non' '-' 'sealed' | 'synchronized' | 'final' } ;
typedecl = mods ( class | interface | enum | record | annotype ) ;
class = 'class' ident [ tparams ] [ 'extends' type ] [ 'implements' types ] [ 'permits' types ] body ;
interface = 'interface' ident [ tparams ] [ 'extends' types ] [ 'permits' types ] body ;
enum = 'enum' ident [ 'implements' types ] '{' [ econst { ',' econst } ] [ ',' ] [ ';' { member } ] '}' ;
econst = annotations ident [ '(' [ args ] ')' ] [ body ] ;
record = 'record' ident [ tparams ] '(' [ params ] ')' [ 'implements' types ] body ;
annotype = '@' 'interface' ident '{' { member } '}' ;
body = '{' { member } '}' ;
member = ';' | mods ( class | interface | enum | record | annotype | block | [ tparams ] ident ( '(' [ params ] ')' throws block | block ) | [ tparams ] ( type | 'void' ) ident '(' [ params ] ')' dims throws [ 'default' eval ] ( block | ';' ) | type declarators ';' ) ;
throws = [ 'throws' types ] ;
dims = { annotations '[' ']' } ;
tparams = '<' tparam { ',' tparam } '>' ;
tparam = annotations ident [ 'extends' type { '&' type } ] ;
types = type { ',' type } ;
type = annotations ( PRIM | ident [ targs ] { '.' annotations ident [ targs ] } ) dims ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type | annotations '?' [ ( 'extends' | 'super' ) type ] ;
params = param { ',' param } ;
param = { annotation | 'final' } type ( [ annotations '...' ] ident dims | [ ident '.' ] 'this' ) ;
declarators = declarator { ',' declarator } ;
declarator = ident dims [ '=' init ] ;
init = expr | '{' [ init { ',' init } ] [ ',' ] '}' ;
block = '{' { bstmt } '}' ;
bstmt = stmt | local ';' | mods ( class | interface | enum | record ) ;
local = { annotation | 'final' } type declarators ;
stmt = block | ';' | action ';' | ident ':' stmt | 'assert' expr [ ':' expr ] ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | for | switchx | ( 'break' | 'continue' ) [ ident ] ';' | 'yield' expr ';' | 'return' [ expr ] ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | try ;
for = 'for' '(' ( [ local | exprs ] ';' [ expr ] ';' [ exprs ] | { annotation | 'final' } type ident dims ':' expr ) ')' stmt ;
exprs = expr { ',' expr } ;
switchx = 'switch' '(' expr ')' '{' { label ( ':' { bstmt } | '->' ( expr ';' | block | 'throw' expr ';' ) ) } '}' ;
label = 'case' clabel { ',' clabel } [ 'when' expr ] | 'default' ;
clabel = cond | 'default' | jpattern ;
jpattern = { annotation | 'final' } type ( ident | '(' [ jpattern { ',' jpattern } ] ')' [ ident ] ) ;
try = 'try' ( '(' res { ';' res } [ ';' ] ')' block { catch } [ 'finally' block ] | block ( catch { catch } [ 'finally' block ] | 'finally' block ) ) ;
res = { annotation | 'final' } type ident '=' expr | call ;
catch = 'catch' '(' { annotation | 'final' } type { '|' type } ident ')' block ;
expr = lambda | cond | assigned ;
assigned = jlhs ( '=' | AUG | '>' '>' '=' | '>' '>' '>' '=' ) expr ;
jlhs = ident | '(' jlhs ')' | primary { jpart } ( '.' ident | '[' expr ']' ) ;
action = assigned | ( '++' | '--' ) postfix | jlhs ( '++' | '--' ) | primary { jpart } ( '(' [ args ] ')' | '.' [ targs ] ident '(' [ args ] ')' | '.' [ targs ] newx ) | newx | switchx ;
lambda = ( ident | '(' [ lparam { ',' lparam } ] ')' ) '->' ( <expr ! '{'> | block ) ;
lparam = ident | param ;
cond = binary [ '?' expr ':' ( cond | lambda ) ] ;
binary = unary { ( BIN | '<' | '>' [ '>' [ '>' ] ] | '>' '=' | '&' | '+' | '-' | '*' | '|' ) ( unary | lambda ) | 'instanceof' ( type | jpattern ) } ;
unary = { '+' | '-' | '!' | '~' | '++' | '--' | cast } postfix ;
cast = '(' type { '&' type } ')' ;
postfix = ( call | switchx | castlambda ) { '++' | '--' } ;
castlambda = cast lambda ;
call = primary { jpart } ;
jpart = '.' ( ident | [ targs ] ident '(' [ args ] ')' | 'this' | 'super' | 'class' | [ targs ] newx ) | '[' expr ']' | '(' [ args ] ')' | '::' [ targs ] ( ident | 'new' ) ;
primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | ident | '(' expr ')' | newx | ( PRIM | ident [ targs ] { '.' ident [ targs ] } ) ( dims '.' 'class' | dims '::' ( ident | 'new' ) ) | 'void' '.' 'class' ;
newx = 'new' annotations [ targs ] ( PRIM | ident [ targs ] { '.' ident [ targs ] } ) ( '(' [ args ] ')' [ body ] | { annotations '[' [ expr ] ']' } [ '{' [ init { ',' init } ] [ ',' ] '}' ] ) ;
args = expr { ',' expr } ;
"""
