"""Template residue, filler, error pages and script notices in place of content.

Lines are counted by host; lines that recur in most documents of a host are its boilerplate and are subtracted. What is left (of a page
that is nothing but boilerplate, all of it) is read
sentence by sentence, without code and quotations: a placeholder or a value that stands where a word should, a sentence
that is filler, or one that begins as an error page or a notice that scripts are required does. A sentence that
only talks about such things begins otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrill.llm.prefilter import likely
from sparkrill.storage import written

HOST_SHARE = 0.5  # of a host's documents that have a line, for boilerplate
HOST_COUNT = 10  # and documents that have it at least: of fewer, nothing can be called recurrent
NOTICE_LINE = 160  # characters: 16 words of notices are not longer
BARE = 0.9  # of the letters of a page that is nothing but recurrent lines
FEW_LINES = 500_000  # recurrent lines of all hosts together that are given to all tasks
LOREM_WORDS = 3

_CODE = re.compile(r"```.*?(?:```|\Z)|<(code|pre)\b.*?</\1>", re.S | re.I)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|„[^“”\n]{1,120}[“”]|「[^」\n]{1,120}」|『[^』\n]{1,120}』")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_BULLET = re.compile(r"^(?:[>*+•·\-–]+\s*|#{1,6}\s+|\d{1,3}[.)]\s+)+")

_NAME = r"[A-Za-z][A-Za-z0-9_.\- ]{0,40}?"
# The forms of unfilled placeholders.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?[#/^&>]?\s*{_NAME}\s*(?:\|[^{{}}\n]{{0,40}})?\}}?\}}\}}|\$\{{\s*{_NAME}\s*\}}|\{{%=?-?\s*{_NAME}\s*-?%\}}|<%=?-?\s*{_NAME}\s*-?%>|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>"
    rf"|@@\s*{_NAME}\s*@@|(?<![\w_])__(?!(?:init|main|name|file|call|dict|doc|str|repr|class|all|version)__){_NAME}__(?![\w_])|%\(\s*{_NAME}\s*\)[sd]|%%?[A-Za-z][A-Za-z0-9_.]{{2,40}}%%?(?![A-Za-z0-9])"
    rf"|(?<![\w#&])#[A-Za-z][A-Za-z0-9_.]{{1,40}}#(?![\w#])|(?<![{{$%\w])\{{(?:[A-Za-z][A-Za-z0-9_.]{{0,40}}|\d)\}}(?!\}})|«[A-Za-z][A-Za-z0-9_.]{{1,40}}»"
    rf"|【\s*(?:[請请]?(?:填入|輸入|输入|填寫|填写)|ここに)[^】\n]{{0,40}}】|\((?:add|insert|enter|fill in)\s+(?:[A-Za-z]\w*[_.]\w+|[a-z]+[A-Z]\w*|[A-Za-z]+)\)|\[(?:INSERT|Insert|insert|ADD|Add|add|ENTER|Enter|enter|YOUR|Your|your)\s[^\]\n]{{1,40}}\]"
    rf"|<(?:YOUR|INSERT|ENTER|ADD|COMPANY|FIRST|LAST|USER)[ _][A-Z][A-Z _]{{1,30}}>|<{_NAME} (?:goes|comes) here>|<!--[^>\n]{{0,60}}-->\s*(?:TBD|TODO|XXX+)|\[object Object\]|\bXXXX+\b"
)
# Values that stand for a missing one, where a word or name should be.
_VALUE = r"(?:NaN|undefined|null|None|Invalid Date|TBD)"
FAILED_VALUE = re.compile(
    rf"\b(?:Dear|Hi|Hello|Hola|Welcome),\s+{_VALUE}\b|\b(?:Dear|Hi|Hello|Hola|Published|Posted|Updated|Author:?|By|Source:|Tags:|More:|Read more:)\s+{_VALUE}\b|\bfor {_VALUE} is\b"
    r"|\bInvalid Date\b|(?<!into )(?<!to )(?<!as )(?<!is )(?<!was )(?<!or )(?<!return )(?<!returns )(?<!returned )(?<!shows )(?<!showed )(?<!print )(?<!prints )(?<!printed )(?<!called )\bNaN\b(?! values?\b)"
    r"|\bundefined\b(?! (?:value|variable|behaviou?r|function|reference|symbol|property|method|term|field|name|is not)s?\b)(?<!is undefined)(?<!was undefined)(?<!are undefined)(?<!be undefined)(?<!left undefined)(?<!remains undefined)"
    r"|(?<=[a-z] )None\b(?! of\b)|(?<=[a-z] )null\b(?! (?:value|pointer|hypothes[ie]s|check|and void|result|model|string|field|column|byte|set|island)s?\b)(?<!is null)(?<!was null)(?<!be null)(?<!are null)(?<!a null)(?<!not null)(?<!or null)"
)
# How error pages begin, in eight languages.
ERROR_PAGE = re.compile(
    r"(?:http\s*)?(?:error|erreur|fehler|erro)?\s*:?\s*[45]\d\d\s*[:\-–—,|]?\s*(?:error|(?:page |file |the page (?:was )?)?not found|forbidden|unauthori[sz]ed|internal server error|bad (?:gateway|request)|service (?:temporarily )?unavailable|gateway time-?out|too many requests|gone|página no encontrada|página não encontrada|page (?:introuvable|non trouvée)|seite nicht gefunden|找不到|頁面不存在|页面不存在)"
    r"|(?:error|erreur|fehler|erro)\s+[45]\d\d\b|[45]\d\d$"
    r"|(?:access|permission|request) (?:is |was |has been )?(?:denied|blocked|forbidden)\b|internal server error|bad gateway|service (?:is )?(?:temporarily )?unavailable|gateway time-?out|too many requests|(?:page|file) not found|not found$|forbidden$|unauthori[sz]ed$"
    r"|(?:the |your )?(?:connection|request|session) (?:has |was )?(?:timed out|expired|reset)|(?:oops|sorry|uh-?oh|whoops)[!,.…]*\s*(?:something went wrong|an error|we (?:couldn|can)['’]?t|we (?:could|can)not|this page|that page|the page)"
    r"|we (?:couldn['’]?t|can['’]?t|could not|cannot) find (?:that|the|this|your) (?:page|file|content)|something went wrong|(?:could not|couldn['’]t|cannot|can['’]t|unable to|failed to) (?:connect to|load|reach|find|open|display) (?:the |this |your )?(?:database|server|page|content|network|backend|host|site|resource|file)|an (?:unexpected |internal )?error (?:has )?occurred|application error\b|fatal error\b"
    r"|(?:this|the|that) (?:requested )?(?:page|content|url|site|resource|article)(?: you (?:requested|are looking for))? (?:has been (?:removed|deleted|moved)|was (?:removed|deleted|not found)|is (?:not available|no longer available|unavailable|currently unavailable|not found)|isn['’]?t available|does(?:n['’]?t| not) exist|could not be (?:found|loaded)|cannot be (?:found|displayed))"
    r"|checking your browser|(?:please )?verify (?:that )?you are (?:a )?human|your (?:ip(?: address)?|access|session) (?:has |was |is )?(?:been )?(?:blocked|denied|expired)|(?:the )?server (?:is (?:busy|down|overloaded|under maintenance)|encountered|met an|error)|(?:site|down) (?:is )?(?:under|for) maintenance"
    r"|error interno del servidor|página no encontrada|(?:la )?página (?:solicitada )?(?:no existe|no está disponible)|acceso denegado|servicio no disponible|no (?:se ha encontrado|hemos encontrado|pudimos encontrar|encontramos) (?:la|esta|esa) página|tiempo de espera agotado|(?:su|la|tu) sesión ha (?:expirado|caducado)|algo salió mal|no se pudo (?:conectar|cargar|encontrar)|se ha producido un error|demasiadas solicitudes"
    r"|erro interno d[oe] servidor|página não encontrada|(?:a )?página (?:solicitada )?não (?:existe|foi encontrada|está disponível)|acesso negado|serviço indisponível|não (?:encontramos|foi possível encontrar) (?:a|esta|essa) página|(?:a |sua )?sessão expir|tempo (?:limite )?esgotado|algo deu errado|não foi possível (?:conectar|carregar|encontrar)|ocorreu um erro|muitas solicitações"
    r"|erreur interne|erreur (?:du )?serveur|page (?:introuvable|non trouvée)|(?:cette|la) page (?:demandée )?(?:n['’]existe|est introuvable|n['’]est (?:pas|plus) disponible)|accès (?:refusé|interdit)|service (?:temporairement )?indisponible|délai (?:d['’]attente |de connexion )?dépassé|(?:votre )?session (?:a )?expiré|impossible de (?:se connecter|charger|trouver|joindre|afficher)|une erreur (?:est survenue|s['’]est produite)|trop de requêtes"
    r"|interner serverfehler|(?:interner )?fehler (?:des|im) server|(?:die |diese )?(?:angeforderte )?seite (?:wurde |konnte |ist )?(?:leider )?nicht (?:gefunden|verfügbar|erreichbar|existiert)|zugriff verweigert|(?:dienst|service) (?:ist )?(?:derzeit |vorübergehend )?nicht verfügbar|zeitüberschreitung|(?:ihre |die )?sitzung (?:ist )?abgelaufen|(?:die )?verbindung (?:zu[rm] \w+ )?(?:ist )?(?:fehlgeschlagen|unterbrochen)|keine verbindung|(?:es ist )?ein fehler (?:ist )?aufgetreten|zu viele anfragen"
    r"|(?:お探しの)?ページ(?:が|は)(?:見つかりません|存在しません|表示できません)|お探しのページ|(?:内部)?サーバー?(?:内部)?エラー|アクセス(?:が|は)?(?:拒否|できません|禁止)|このページ(?:は|を)(?:存在|表示でき)|接続が?タイムアウト|セッションの(?:有効)?期限|(?:データベース|サーバー?)(?:に|へ)接続できません|(?:予期しない)?エラーが発生しました|ただいま(?:アクセスが集中|メンテナンス)|問題が発生しました|サービスを?(?:は)?利用できません"
    r"|(?:抱歉[，,！!]?|很抱歉[，,]?|對不起[，,]?|对不起[，,]?|哎呀[，,！!]?|糟糕[，,！!]?)?(?:找不到(?:網頁|网页|頁面|页面|該頁|该页|您)|(?:您(?:要找|訪問|访问)的)?(?:頁面|页面|網頁|网页)(?:不存在|無法|无法|已(?:被)?(?:刪除|删除|移除)|走丟|走丢)|無法(?:顯示|開啟|連上|存取|載入|連線|連接|取得)|无法(?:显示|打开|访问|连接|加载|获取)|(?:伺服器|服务器)(?:內部|内部|發生|发生|出|忙|错|錯|开小差|無法|无法|暫時|暂时)|(?:連線|连接|請求|请求)(?:已)?(?:逾時|超时|超時)|(?:存取|訪問|访问)(?:被)?(?:被拒|拒絕|拒绝)|拒[絕绝](?:存取|訪問|访问)|(?:系統|系统)(?:錯誤|错误|忙|維護|维护|發生|繁忙)|(?:您|你)(?:沒有|没有)(?:權限|权限)|(?:登入|登录|工作階段|会话|會話)(?:已)?(?:逾時|过期|過期|超时)|(?:請求|请求)(?:過於|过于|過多|过多)|出[現现]?(?:了)?(?:點|点)?(?:錯|错|問題|问题))",
    re.I,
)
# Error pages by their build: an apology, a thing of the web, and a state it is in, with which the sentence ends.
_SORRY = r"(?:(?:oops|ops|oups|sorry|uh-?oh|whoops|hmm+|we['’]?(?:re| are) sorry|lo sentimos|désolée?s?|leider|entschuldigung|desculpe|申し訳ありません|抱歉)(?:,? but)?[!,.…:; ]+)?"
_THING = r"(?:(?:the|this|that|your|our|a|an) )?(?:(?:requested|remote|target|web) )?(?:page|web ?page|site|website|url|address|resource|content|server|connection|host|database|document|file|session|request|article|application|app|service|link|account)"
_WHICH = r"(?: (?:that )?(?:you(?:['’]re| are| were)? (?:requested|looking for|trying to \w+|tried to \w+)))?(?: /\S*)?"
_STATE = r" (?:can(?:no|['’])?t be|can not be|could(?: not|n['’]t) be|(?:was|is|are|were|has been|have been)(?: not|n['’]t)?|does(?: not|n['’]t)|no longer|has(?: not|n['’]t)?|failed to) ?(?:(?:been|currently|temporarily|permanently|no longer|not) )*(?:found|reached|displayed|available|loaded|load|shown|opened|exists?|interrupted|refused|reset|blocked|removed|moved|deleted|unavailable|denied|closed|timed out|expired|responding|respond|invalid|broken|connect|limited|suspended|disabled)"
_REST = r"(?:,? or [^.!?]{1,60}|(?: due to| because of| for) [^.!?]{1,40}|(?: on| from| by| at| in)? ?(?:this|the|our|your)? ?(?:server|site|network|browser|moment|time|right now|now|anymore|any more|any longer|administrator))?\s*[.!。]?$"
BUILT_ERROR = re.compile(
    _SORRY + "(?:" + _THING + _WHICH + _STATE + _REST
    + r"|you (?:do(?: not|n['’]t) have|lack) (?:the )?(?:necessary )?(?:permissions?|access|rights?) to|you (?:have been|are|were) (?:blocked|banned|logged out|rate.?limited)|you are not (?:authori[sz]ed|allowed|permitted) to (?:access|view|see|open)"
    r"|we (?:can['’]?t|cannot|can not|could not|couldn['’]?t|were unable to) (?:seem to )?(?:find|reach|load|open|display|locate|process) (?:the |that |this |your )?(?:page|site|file|content|request|resource|url)|our (?:systems?|servers?) (?:have|has) detected (?:unusual|suspicious)"
    r"|(?:un problème|une erreur inattendue) (?:est survenue?|s['’]est produite?)|(?:la|esta|cette|a|essa) p[áa]gin?[ae]? (?:que (?:buscas?|está buscando|você (?:procura|está procurando)|vous (?:cherchez|recherchez)) )?(?:no se puede|no se encuentra|no (?:existe|está)|não (?:existe|está|foi|pode)|n['’]existe|est introuvable)"
    r"|(?:diese|die) seite (?:existiert|ist|wurde|konnte|kann) (?:leider )?nicht|(?:ページ|サイト|サーバー?|コンテンツ)(?:が|は|に|を)(?:見つかり|存在し|表示でき|接続でき|利用でき|読み込め)|(?:系统|系統|服务|服務|网络|網路|服务器|伺服器)(?:繁忙|异常|異常|错误|錯誤|出错|出錯|不可用|无响应|無回應|暂不可用|暫停)"
    r"|(?:please )?try (?:again|reloading|refreshing)(?: later| in a (?:few|moment)[^.!?]{0,20}| the page)?[.!]?$|(?:bitte versuchen sie es|veuillez réessayer|inténtalo de nuevo|tente novamente)[^.!?]{0,20}(?:später|plus tard|más tarde|mais tarde)"
    r"|http (?:status|error|code) [45]\d\d|error (?:code )?[45]\d\d\d?\b|(?:temporarily|currently) (?:unavailable|offline|out of service|closed for)|(?:site|page|service|server|application|database|proxy|network|script|runtime|parse|syntax|connection) error(?: page)?[.!]?$|(?:error|failure) (?:establishing|connecting to|loading|fetching|opening|retrieving|reading) |failed to (?:fetch|load resource)[.!]?$|whitelabel error|upstream connect|attention required!?"
    r"|(?:err|dns)_[a-z]+_[a-z_]+\b|nxdomain\b"
    + ")",
    re.I,
)
_BUILT_HINTS = ("not ", "n't", "n’t", "no ", "não ", "unavailable", "offline", "blocked", "banned", "limited", "refused", "interrupted", "moved", "removed", "deleted", "expired", "timed out", "denied", "suspended", "disabled", "closed", "broken", "invalid", "reset", "error", "failure", "failed", "try ", "http ", "unusual", "suspicious", "survenu", "produite", "introuvable", "nicht", "versuchen", "réessayer", "inténtalo", "tente ", "required", "upstream", "err_", "dns_", "nxdomain", "page", "ません", "め", "繁忙", "异常", "異常", "不可用", "出", "错", "錯", "无响应", "無回應", "暂", "暫")
# The words of which notices are built. A line of these alone, with a thing and a state or two states among them, says nothing else.
THINGS = frozenset(
    "page webpage site website url link address resource server host database connection request session access network account browser file document service application app gateway proxy check javascript script scripts cookies "
    "página sitio web servidor acceso conexión servicio sesión site acesso conexão serviço sessão serveur accès connexion seite webseite zugriff verbindung sitzung dienst adresse anfrage".split()
)
STATES = frozenset(
    "error errors found missing denied refused blocked forbidden unauthorized unauthorised unavailable down offline maintenance failed failure invalid expired timeout timed broken disabled deactivated required suspended removed deleted moved wrong bad gone reload retry refresh redirecting unexpected unreachable unknown crashed overloaded busy lost interrupted "
    "inesperado encontrada encontrado disponible denegado caducado expirada indisponível negado inesperada introuvable indisponible refusé interdit expiré survenue gefunden verweigert erlaubt verfügbar deaktiviert abgelaufen fehlgeschlagen fehler erreur erro aufgetreten unerwarteter".split()
)
GLUE = frozenset(
    "the this that a an your our you we to of for on in at by from with and or but is are was were has have had been be it its it's something something's looks look like seems please again later try could can cannot can't couldn't not no isn't aren't doesn't don't does do properly temporarily currently permanently remote status code security must allow enable enabled allowing view content continue kindly turn off back click here go home oops sorry log out need needs requires works best when there too many http https nginx apache cloudflare requested internal all "
    "la el los las un una ha han ocurrido solicitada fue por favor se no está de en para su necesita temporariamente o os as uma não foi solicitado le les une des est pas sont votre pour nicht wurde die der das ein eine ist es ihre ihr angeforderte leider konnte im um zu funcionar mostrar activez aktivieren sie bitte".split()
)
VOCABULARY = THINGS | STATES | GLUE
_CJK_NOTICE = re.compile(
    "無法|无法|不能|訪問|访问|連線|连接|連接|發生|发生|出現|出现|錯誤|错误|此|該|该|您|你|的|網站|网站|網頁|网页|頁面|页面|本|已|被|刪除|删除|移除|找不到|要|不存在|伺服器|服务器|系統|系统|請|请|稍後|稍后|再試|再试|重試|重试|需要|需|必須|必须|啟用|启用|開啟|开启|才能|瀏覽|浏览|逾時|超时|權限|权限|沒有|没有|維護|维护|中"
    "|この|サイト|ページ|サーバー?|に|が|は|を|の|で|アクセス|接続|できません|でした|見つかりません|存在しません|エラー|発生しました|ブラウザ|有効|オン|して|ください|必要です|メンテナンス|表示|再度|お試し|後|javascript|[0-9]+|[ \t　。，、,.!！:：()（）-]"
)
_CJK_STATE = re.compile("無法|无法|不能|錯誤|错误|刪除|删除|移除|找不到|不存在|逾時|超时|啟用|启用|開啟|开启|沒有|没有|維護|维护|できません|見つかりません|存在しません|エラー|有効|オン|必要|メンテナンス")
_CJK_THING = re.compile("網站|网站|網頁|网页|頁面|页面|伺服器|服务器|系統|系统|連線|连接|連接|サイト|ページ|サーバー?|アクセス|接続|javascript", re.I)
_FIRST_KANA_HAN = re.compile("[぀-ヿ㐀-鿿]")
_PARTS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


def _notice(line: str) -> str | None:
    """script or error for a line that is built of the words of notices alone."""
    low = line.lower().replace("’", "'")
    if _FIRST_KANA_HAN.search(low):
        if not (_CJK_STATE.search(low) and _CJK_THING.search(low)) or _CJK_NOTICE.sub("", low):
            return None
        return "script" if "script" in low or "cookies" in low else "error"
    first = _PARTS.search(low)
    if not first or not (first[0] in VOCABULARY or first[0].isdigit()):
        return None
    words = _PARTS.findall(low)
    if not 2 <= len(words) <= 16 or not all(w in VOCABULARY or w.isdigit() for w in words):
        return None
    scripts = "script" in low or "cookies" in low
    things = sum(w in THINGS for w in words)
    states = sum(w in STATES or len(w) == 3 and w[0] in "45" and w.isdigit() for w in words)
    if not (things and states or states > 1 or scripts and things and "enable" in low):
        return None
    return "script" if scripts else "error"


# How notices begin that scripts are required.
SCRIPTS = re.compile(
    r"(?:please )?(?:enable|turn on|activate|allow|switch on) (?:your )?(?:java ?scripts?|scripts?|cookies)\b|(?:you need|you must|you have to|this (?:site|page|app|application|website)|your browser|the browser|we(?:'ve| have)? (?:noticed|detected)|java ?scripts?|scripts?|to (?:use|view|run|continue|see))\b[^.!?]{0,60}\b(?:java ?scripts?|scripts?)\b[^.!?]{0,60}\b(?:enable|require|need|turn|disabled|block|switched|support|activat|run|work|off|on)"
    r"|(?:java ?script|scripts?) (?:is|are|must be|has been|needs? to be|seems? to be|appears? to be) (?:required|disabled|not (?:enabled|supported)|turned off|enabled|off|blocked|needed|switched)|this (?:site|page|app|application) (?:needs|requires|works best with) (?:java ?scripts?|scripts?)"
    r"|(?:we['’]?(?:re| are) sorry,? but|unfortunately,?|it (?:looks like|seems|appears))[^.!?]{0,80}\b(?:java ?script|scripts)\b|(?:your|this|the) browser (?:does(?: not|n['’]t)|can(?:not|['’]t)|has (?:disabled|blocked)|blocks)[^.!?]{0,30}\b(?:java ?script|scripts?)\b|(?:please )?(?:turn|switch) (?:your )?(?:java ?script|scripts|cookies) (?:back )?on\b|java ?script (?:is (?:not available|unavailable|switched off)|not (?:available|detected|found))|(?:es necesario|necesitas?|hay que|se requiere) (?:habilitar|activar|tener)?[^.!?]{0,20}java ?script|(?:para continuar,? |é (?:necessário|preciso) )(?:ativ|habilit)[^.!?]{0,30}java ?script|il (?:faut|est nécessaire)[^.!?]{0,30}java ?script|(?:zum fortfahren|um fortzufahren|zur anzeige)[^.!?]{0,40}java ?script"
    r"|(?:por favor,? )?(?:active|activa|habilite|habilita|permita) (?:el )?(?:java ?script|los scripts)|(?:este sitio|esta página|esta aplicación|su navegador|tu navegador|necesita)\b[^.!?]{0,80}\b(?:java ?script|scripts)"
    r"|(?:por favor,? )?(?:ative|habilite|ligue|permita) (?:o |os )?(?:java ?script|scripts)|(?:este site|esta página|este aplicativo|o seu navegador|seu navegador|você precisa)\b[^.!?]{0,80}\b(?:java ?script|scripts)"
    r"|(?:veuillez |merci d['’])?(?:activer|activez|autoriser|autorisez) (?:le |les )?(?:java ?script|scripts)|(?:ce site|cette page|cette application|votre navigateur|vous devez)\b[^.!?]{0,80}\b(?:java ?script|scripts)"
    r"|(?:bitte )?(?:aktivieren|schalten|erlauben) sie (?:java ?script|skripte)|(?:bitte )?java ?script (?:aktivieren|einschalten)|(?:diese (?:seite|website|anwendung)|dieser dienst|ihr browser|dein browser|sie (?:müssen|benötigen))\b[^.!?]{0,80}\b(?:java ?script|skripte?)"
    r"|(?:この(?:サイト|ページ|アプリ)|お使いのブラウザ|ご利用のブラウザ|ブラウザ)[^。]{0,40}(?:java ?script|スクリプト)|(?:java ?script|スクリプト)(?:を|が|は)[^。]{0,20}(?:有効|無効|必要|オン|許可)"
    r"|(?:[請请](?:先)?(?:在[^。，]{0,12})?(?:啟用|启用|開啟|开启|打開|打开|允許|允许)|(?:本站|本頁|本页|此網站|此网站|此頁|此页|這個網站|这个网站|該網站|该网站|瀏覽|浏览|使用本)[^。]{0,20}(?:需要|需|必須|必须))[^。]{0,20}(?:java ?script|指令碼|脚本|腳本)|(?:您|你)的(?:瀏覽器|浏览器)[^。]{0,20}(?:java ?script|指令碼|脚本|腳本)|(?:偵測到|检测到)[^。]{0,20}(?:java ?script|指令碼|脚本|腳本)",
    re.I,
)
# How filler begins.
FILLER = re.compile(
    r"(?:add|insert|enter|write|type|put|describe|paste) (?:your|a|an|some|the|something|anything)\b[^.!?]{0,40}\bhere[.!]?$|(?:add|insert|enter|write|type|put|paste) (?:[a-z]+ ){0,2}(?:text|copy|content|headline|title|description|paragraph|caption|quote|summary|article|image|details) here[.!]?$|(?:your|the|body|main) (?:[a-z]+ ){0,2}(?:text|copy|content|headline|title|description|paragraph|caption|summary|details) (?:goes|comes|will go) here|lorem ipsum[.!…]*$|(?:text|inhalt|beschreibung) folgt[.!…]*$|(?:contenido|contenu|conteúdo|inhalt) (?:de ejemplo|de muestra|d['’]exemple|de exemplo|de teste)|(?:todo|tbd|fixme)\s*[:\-–—]|(?:todo|tbd|fixme)[.!]?$|(?:content|text|description|article|copy|summary|details) (?:is )?(?:coming soon|to be (?:added|written|supplied|provided|determined|announced))|(?:body|intro|main|lead|article) (?:text|copy|content) (?:to be|will be|is to be)|(?:placeholder|dummy|sample|filler) (?:text|copy|content|paragraph)\b[^.!?]{0,40}[.!]?$|(?:sample|dummy|placeholder|filler|example) (?:text|copy|content|paragraph|sentence)s?\b(?: here| goes here)?[.,:!]?(?:$|\s*(?:do not|to be|replace|here|only|please))|(?:your|body|my|main|more|the) (?:text|copy|content|headline|title|paragraph)s? (?:goes|comes|will go|to be added|to go) here|(?:body|draft|headline|final|more|text|main)? ?(?:copy|text|content) to (?:follow|come)\b|some text, some more text"
    r"|(?:replace|overwrite|edit|delete) (?:this|the) (?:paragraph|text|sentence|content|copy|line)\b|(?:insert|add|enter|type|write|put) (?:your|some|the|body) (?:text|copy|content)\b[^.]{0,20}(?:here|$)|paragraph placeholder|text placeholder|placeholder(?: only)?[.,!]?$|this is (?:a )?(?:placeholder|dummy|sample|filler)\b|lorem ipsum dolor"
    r"|hier (?:steht|kommt|folgt|entsteht)\b[^.]{0,30}\b(?:text|inhalt)|(?:dies(?:er)? (?:ist )?(?:nur )?(?:ein )?)?(?:blindtext|platzhalter(?:text)?|beispieltext|mustertext|dummytext)\b"
    r"|texto (?:de (?:ejemplo|relleno|prueba|muestra)|provisional)|(?:aquí|acá) (?:va|irá|viene) (?:el|su|tu|un) (?:texto|contenido)|(?:escriba|escribe|inserte|ponga) (?:aquí|su|el|tu) |texto (?:provisório|de (?:exemplo|teste|preenchimento))|aqui (?:vai|vem|entra) (?:o|seu|um) (?:texto|conteúdo)|(?:insira|escreva|digite) (?:aqui|o|seu) "
    r"|texte (?:provisoire|d['’]exemple|de (?:remplissage|test|substitution)|factice|à (?:remplacer|venir))|faux[- ]texte|(?:votre|ici (?:votre|le)|insérez (?:votre|le)) (?:texte|contenu)|ceci est un (?:texte|exemple)"
    r"|ここに(?:ダミー|本文|文章|テキスト|説明|内容)|(?:これは)?(?:ダミー|サンプル|仮)(?:の)?(?:文章|テキスト|文|本文)(?:です|が|を|。|$)|(?:テキスト|サンプル|ダミー){2,}"
    r"|(?:這裡|这里|此處|此处|這是|这是)(?:是|為|为|填寫|填写|輸入|输入|放置?|插入)?(?:一段)?(?:範例|范例|示例|示範|占位|佔位|測試|测试|預設|默认|假|說明|说明)?(?:文字|文本|內容|内容|正文|內文)|(?:範例|范例|示例|占位|佔位|測試|测试|預設|默认)(?:文字|文本|內容|内容)(?:[，。,.！]|$)|[請请](?:在此|在這裡|在这里|於此)(?:輸入|输入|填寫|填写)|(?:待補|待补|待填)(?:文字|內容|内容)?(?:[，。]|$)",
    re.I,
)
_EMPTY_WORDS = frozenset("test blah asdf qwer qwerty foo bar baz text bla dummy sample xxx hjkl zxcv lorem ipsum".split())
_WORDS = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"(.{2,12}?)\1{2,}")
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum porta massa rhoncus varius congue mattis lectus tellus sagittis pretium vitae ut et do ex ea eu id est qui non in ad".split()
)
# What a text must contain, in lower case, for a closer look at the sentences with it.
_ERROR_HINTS = (
    "error", "erro ", "erreur", "fehler", "denied", "blocked", "forbidden", "unauthori", "unavailable", "not available", "no longer available", "t available", "not found", "timed out", "time-out", "timeout", "expired", "has been reset", "too many requests",
    "went wrong", "t find", "not find", "unable to", "failed to", "could not", "cannot ", "t load", "t connect", "been removed", "been deleted", "been moved", "was removed", "was deleted", "not exist", "t exist", "you are a human", "you are human", "under maintenance", "for maintenance", "checking your browser", "server is", "server encountered", "server met", "bad gateway", "bad request", "gone",
    "no encontrada", "no existe", "no está disponible", "acceso denegado", "servicio no disponible", "no se ha", "no hemos", "no pudimos", "agotado", "expirado", "caducado", "salió mal", "demasiadas", "no se pudo",
    "não encontrada", "não existe", "não foi", "acesso negado", "indisponível", "não encontramos", "sessão", "esgotado", "deu errado", "muitas solicita",
    "introuvable", "non trouvée", "n'existe", "n’existe", "n'est", "n’est", "accès", "indisponible", "dépassé", "expiré", "trop de requêtes", "impossible de",
    "nicht gefunden", "nicht verfügbar", "nicht erreichbar", "zugriff", "zeitüberschreitung", "abgelaufen", "anfragen", "verbindung",
    "見つかりません", "存在しません", "表示でき", "お探しの", "エラー", "アクセス", "タイムアウト", "期限", "メンテナンス", "問題が発生", "利用できません", "接続でき",
    "找不到", "不存在", "無法", "无法", "伺服器", "服务器", "逾時", "超时", "超時", "存取", "訪問", "访问", "拒絕", "拒绝", "系統", "系统", "權限", "权限", "過期", "过期", "請求", "请求", "除", "出錯", "出错", "出了", "出現", "出现",
)
_SCRIPT_HINTS = ("javascript", "java script", "scripts", "script ", "cookies", "skript", "スクリプト", "指令碼", "脚本", "腳本")
_FILLER_HINTS = (
    "text", "copy to", "copy goes", "content", "paragraph", "placeholder", "dummy", "filler", "goes here", "comes here", "lorem", "ipsum", "amet", "nostrud", "rhoncus", "congue", "tellus", "lectus", "mollit", "sagittis", "fugiat", "pretium", "varius", "mattis",
    "test test", "blah", "asdf", "qwer", "foo bar", "foo foo", "hjkl", "xxx", "sample", "platzhalter", "muster", "contenido", "conteúdo", "contenu", "insira", "escriba", "inserte",
    "todo", "tbd", "fixme", "coming soon", "to be ", " here", "description",
    "ダミー", "サンプル", "テキスト", "ここに", "仮の", "文字", "文本", "內容", "内容", "正文", "內文", "待補", "待补", "待填", "在此", "於此",
)
_PLACEHOLDER_HINTS = ("{", "<%", "<<", "<!--", "<your", "<insert", "<enter", "<add", "<company", "<first", "<last", "<user", "s here", "[[", "[insert", "[add", "[enter", "[your", "@@", "__", "%(", "«", "【", "(add ", "(insert ", "(enter ", "(fill in ", "xxxx", "[object")
_ROUND_MARKS = re.compile(r"#[A-Za-z][A-Za-z0-9_.]+#|%[A-Za-z][A-Za-z0-9_.]+%")
_VALUE_HINTS = ("NaN", "undefined", "Invalid Date", "null", "None", "TBD")
_STATUS = re.compile(r"\b[45]\d\d\b")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")


def _repeated(sentence: str) -> bool:
    """One short unit of a script without blanks, over and over."""
    bare = sentence.rstrip("。！？.、，")
    return len(bare) >= 6 and 3 * len(set(bare)) <= len(bare) + 3 and bool(unit := _UNIT.match(bare)) and len(unit[0]) >= 0.7 * len(bare) and bool(_FIRST_KANA_HAN.search(unit[1]))


def _filler(sentence: str) -> bool:
    if FILLER.match(sentence):
        return True
    words = _WORDS.findall(sentence.lower())
    if words and all(w in _EMPTY_WORDS for w in words) and (len(words) >= 3 or len(set(words)) < len(words)):
        return True
    latin = sum(w in LOREM for w in words)
    return latin >= LOREM_WORDS and latin >= 0.75 * len(words)


def _sentences(bare: str) -> Iterator[str]:
    for line in bare.splitlines():
        if line:
            if "<" in line:
                line = _MARKUP.sub(" ", line)
            for sentence in _SENTENCE.split(line):
                if sentence := _BULLET.sub("", sentence.strip()):
                    yield sentence


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    """All hints in one automaton: a text is read once for them."""
    kinds: dict[str, int] = {}
    for k, hints in enumerate((_ERROR_HINTS, _BUILT_HINTS, _SCRIPT_HINTS, _FILLER_HINTS, _PLACEHOLDER_HINTS)):
        for h in hints:
            kinds[h] = kinds.get(h, 0) | 1 << k
    found = ahocorasick.Automaton()
    for h, bits in kinds.items():
        found.add_word(h, (bits, h))
    found.make_automaton()
    return found


def _bare_page(text: str) -> str | None:
    """The kind of residue of a page that is nothing but its host's recurrent lines: if such lines make up BARE of it."""
    lines = [(sum(map(str.isalpha, line)), evidence(line)) for line in text.split("\n") if line.strip()]
    found = [(n, kind) for n, kind in lines if kind]
    return max(found)[1] if found and sum(n for n, _ in found) >= BARE * sum(n for n, _ in lines) else None


def evidence(text: str, boilerplate: frozenset[int] = frozenset()) -> str | None:
    """The kind of residue in a text (placeholder, filler, error, script), null if there is none. Whole texts of any length.

    boilerplate: hashes of the host's recurrent lines, which are left out before, unless nothing else is left: a page that is nothing but them is residue if BARE of it is.
    """
    if boilerplate:
        import xxhash

        rest = "\n".join([line for line in text.split("\n") if xxhash.xxh64_intdigest(normal_line(line).encode("utf-8", "surrogatepass"), seed=42) not in boilerplate])
        if not any(map(str.isalpha, rest)):
            return _bare_page(text)
        text = rest
    low = text.lower()
    numbered = bool(_STATUS.search(text))
    met = {hint for _, hint in _hints().iter(low)}
    errors, built, scripts, fillers = ([h for kinds, h in met if kinds & kind] for kind in (1, 2, 4, 8))
    marks = any(kinds & 16 for kinds, _ in met) or bool(_ROUND_MARKS.search(text))
    values = any(h in text for h in _VALUE_HINTS)
    wide = not text.isascii() and bool(_FIRST_KANA_HAN.search(text))
    if not (errors or built or numbered or scripts or fillers or marks or values or wide):
        return None
    bare = _QUOTED.sub(" ", _CODE.sub("\n", text))
    if marks and PLACEHOLDER.search(bare) or values and FAILED_VALUE.search(bare):
        return "placeholder"
    if not (errors or built or numbered or scripts or fillers or wide):
        return None
    if errors or built or scripts or numbered or wide:
        for line in bare.splitlines():
            if 4 <= len(line) <= NOTICE_LINE:
                if "<" in line:
                    line = _MARKUP.sub(" ", line)
                if found := _notice(_BULLET.sub("", line.strip())):
                    return found
    for sentence in _sentences(bare):
        small = sentence.lower()
        if (numbered and _STATUS.search(small[:24]) or any(h in small for h in errors)) and ERROR_PAGE.match(small):
            return "error"
        if built and any(h in small for h in built) and BUILT_ERROR.match(small):
            return "error"
        if scripts and any(h in small for h in scripts) and SCRIPTS.match(small):
            return "script"
        if fillers and any(h in small for h in fillers) and _filler(small):
            return "filler"
        if wide and _repeated(sentence):
            return "filler"
    return None


_NUMBER = re.compile("[0-9]+")


def normal_line(line: str) -> str:
    return _NUMBER.sub("0", line).strip(" \r\t").lower()


def host_of(domain: Column) -> Column:
    """The host a document comes from, without www., m. and the like counting as part of it; null stays null."""
    return F.regexp_replace(F.lower(F.trim(domain)), r"^(?:www|m|amp)\.", "")


def boilerplate(docs: DataFrame, id_col: str, text_col: str, domain_col: str, share: float = HOST_SHARE, count: int = HOST_COUNT) -> DataFrame:
    """(host, lines array<bigint>): hashes of the normalised lines that at least `share` and `count` of a host's documents have.

    Exact counts of all lines of all documents, pre-aggregated; as each of them is in a good part of the host's documents, a host has few.
    """
    host = host_of(F.col(domain_col))
    filled = docs.filter(host.isNotNull() & F.col(text_col).rlike(r"\S")).select(host.alias("host"), F.col(text_col).alias("text"))
    normal = F.expr(r"array_distinct(transform(split(text, '\n'), x -> xxhash64(lower(trim(BOTH ' \r\t' FROM regexp_replace(x, '[0-9]+', '0'))))))")
    lines = filled.select("host", F.explode(normal).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= count)
    sizes = filled.groupBy("host").agg(F.count("*").alias("docs"))
    blank = F.xxhash64(F.lit(""))
    return lines.join(sizes, "host").filter((F.col("n") >= share * F.col("docs")) & (F.col("line") != blank)).groupBy("host").agg(F.collect_set("line").alias("lines"))


def residues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """(id, kind) of the documents that hold residue; kind is placeholder, filler, error or script.

    Null, empty and blank texts are no case; documents of a null domain have no boilerplate. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [evidence(t, frozenset([x & 0xFFFFFFFFFFFFFFFF for x in lines]) if lines else frozenset()) for t, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["id", "kind"]).filter(pa.array([k is not None for k in kinds], pa.bool_()))

    known = written(boilerplate(docs, id_col, text_col, domain_col), "residue-lines")
    texts = docs.filter(F.col(text_col).rlike(r"\S")).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), host_of(F.col(domain_col)).alias("host"))
    size = known.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)) + F.count("*")).first()[0]
    if size <= FEW_LINES:
        # A hash and its host's name: some tens of megabytes at most. No text moves.
        joined = texts.join(F.broadcast(known), "host", "left")
    else:
        # Only documents of hosts that have recurrent lines move.
        both = likely(texts.filter("host is not null"), known.select("host"), "host", split=True)
        none = F.lit(None).cast("array<bigint>").alias("lines")
        still = both.filter("not _may").select("id", "text", none).unionByName(texts.filter("host is null").select("id", "text", none))
        joined = both.filter("_may").drop("_may").join(known, "host", "left").select("id", "text", "lines").unionByName(still)
    return joined.select("id", "text", "lines").mapInArrow(run, "id bigint, kind string").select(F.col("id").alias(id_col), "kind")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """The documents without residue."""
    return docs.join(residues(docs, id_col, text_col, domain_col).select(id_col).distinct(), id_col, "left_anti")
