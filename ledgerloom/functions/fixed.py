"""Fixed values of the evidence rules: terms and patterns that decide which reports count.

Results depend on each of these, so they are stated in full and in their order;
patterns are searched without regard to case. The rules that use them are in
``operators/products.py``, and every rule takes other values as arguments.
"""

from __future__ import annotations

# Issue language of every product, what speaks against a report, and what decides all the same.
ISSUE_TERMS = (
    "crash", "crashes", "crashed", "freeze", "freezes", "frozen", "hang", "hangs", "failed", "failure", "bug", "broken", "corrupt", "corrupted",
    "corruption", "regression", "slow", "lag", "performance", "install", "won't open", "does not open", "can't open", "cannot open", "decode", "render",
    "export", "compatibility", "plugin", "workflow",
)
NON_REPORT_TERMS = (
    "release notes", "changelog", "what's new", "whats new", "announcement", "download", "version history", "new features",
)

# DaVinci Resolve, what names the product, a beta, another version, an issue.
RESOLVE = {
    "product": r"\b(?:davinci\s+resolve|resolve\s+studio|resolve)\b",
    "versioned": r"\bdavinci\s+(?:version\s+)?v?\d{1,2}(?:\.\d+){0,2}\b",
    "beta": r"\b(?:public\s+beta|beta\s*\d*|21\.0b\d*|21b\d+|21\.0b\s+build\s+20|build\s+20)\b",
    "major": r"\b(?:davinci\s+resolve(?:\s+studio)?|resolve(?:\s+studio)?|davinci|version)\s+v?(\d{1,2})(?:\.\d+){0,2}\b",
    "issue": (
        r"\b(?:crash(?:es|ed|ing)?|freez(?:e|es|ing|en)|hang(?:s|ing)?|fail(?:ed|s|ure|ing)?|error|bug|broke|broken|breaks|corrupt(?:ed|ion)?|regression|slow|"
        r"lag(?:gy)?|won't\s+open|can't\s+open|cannot\s+open|does\s+not\s+open|decode|install(?:ation)?\s+issue|problem)\b"
    ),
}

# Premiere Pro.
PREMIERE = {
    "product": r"\b(?:adobe\s+)?premiere\s+pro\b",
    "build_65": r"\bbuild\s*65\b",
    "prerelease": (
        r"\b(?:public\s+beta|beta|pre[-\s]?release|prerelease)\s+(?:premiere\s+pro\s+)?26\.2(?:\.0)?\b|\b26\.2(?:\.0)?\s+(?:public\s+beta|beta|pre[-\s]?release|"
        r"prerelease)\b"
    ),
    "issue": (
        r"\b(?:crash(?:es|ed|ing)?|freez(?:e|es|ing|en)|hang(?:s|ing)?|lag(?:gy)?|slow(?:down)?|sluggish|fail(?:ed|s|ure|ing)?|error|bug|broke|broken|"
        r"regression|rollback|revert(?:ed|ing)?|export|render|install(?:ation)?|compatib(?:le|ility)|plugin|project\s+(?:open|opening|load|loading)|timeline|"
        r"media|decode|audio|video|corrupt(?:ed|ion)?|data\s+loss)\b"
    ),
    "how_to": r"\b(?:how\s+do\s+i|how\s+to|can\s+someone\s+explain|where\s+is|feature\s+request|requesting\s+a\s+feature)\b",
    "note": r"\b(?:release\s+notes|what'?s\s+new|announcement|download|version\s+history|new\s+features)\b",
    "broke": r"\b(?:after\s+updat|since\s+updat|regression|broke|broken)\b",
}

# Acrobat editions.
ACROBAT = {
    "reader": r"\b(?:adobe\s+)?acrobat\s+reader(?:\s+dc)?\b|\badobe\s+reader\b|\breader\s+dc\b|\bcom\.adobe\.reader\b",
    "pro": r"\b(?:adobe\s+)?acrobat\s+pro(?:\s+dc)?\b|\badobe\s+acrobat\s+dc\s+pro\b|\bcom\.adobe\.acrobat\.pro\b",
    "bare": r"\b(?:adobe\s+)?acrobat\b",
    "license": (
        r"licen[sc]e|licen[sc]ed|subscription|entitlement|acrobat\s+standard|standard\s+or\s+(?:acrobat\s+)?pro|pro\s+or\s+(?:acrobat\s+)?standard|"
        r"signs?\s+in\s+with|switch(?:es|ed|ing)?\s+to\s+(?:licensed|pro\b|standard)"
    ),
    "issue": (
        r"\b(?:crash(?:e[sd])?|won'?t\s+(?:open|launch|install|start|print)|(?:fail(?:s|ed|ure)?|unable)\s+to\s+(?:install|update|open|launch|print|sign|save|"
        r"load|activate)|install(?:ation)?\s+(?:fail(?:s|ed|ure)?|error(?:s|ed)?|broke|broken|invalid|problem|issue)|update\s+(?:fail(?:s|ed|ure)?|error(?:s|"
        r"ed)?|broke|broken|invalid|problem|issue)|print(?:ing)?\s+(?:(?:fail(?:s|ed|ure)?|error(?:s|ed)?|broke|broken|invalid|problem|issue)|regression|blank)|"
        r"(?:pdf|render(?:ing)?|display)\s+(?:blank|broken|garbled|corrupt|wrong|not\s+render)|form(?:s|\s+field)?\s+(?:broke|broken|not\s+work|fail(?:s|ed|"
        r"ure)?|blank)|(?:signature|signing|certificate)\s+(?:fail(?:s|ed|ure)?|error(?:s|ed)?|broke|broken|invalid|problem|issue)|freeze[sd]?|frozen|hang(?:s|"
        r"ing)?|not\s+responding|high\s+(?:cpu|memory)|memory\s+leak|corrupt(?:ed|ion)?|data\s+loss|deploy(?:ment)?\s+(?:fail(?:s|ed|ure)?|error(?:s|ed)?|broke|"
        r"broken|invalid|problem|issue)|licens(?:e|ing)\s+(?:fail(?:s|ed|ure)?|error(?:s|ed)?|broke|broken|invalid|problem|issue)|activation\s+(?:fail(?:s|ed|"
        r"ure)?|error(?:s|ed)?|broke|broken|invalid|problem|issue)|(?:plugin|add-?in|extension)\s+(?:broke|broken|not\s+work|crash(?:e[sd])?|incompat\w*)|"
        r"regression|broke\s+after|broken\s+after|stopped\s+working\s+after|no\s+longer\s+works)\b"
    ),
    "note": (
        r"\b(release\s+notes|what'?s\s+new|announcing|announcement|new\s+feature|feature\s+request|please\s+add|would\s+be\s+nice|pric(?:e|ing)|"
        r"subscription\s+cost|too\s+expensive|refund|how\s+do\s+i|how\s+to)\b"
    ),
    "failure": r"\b(crash|fail|broke|broken|error|corrupt|freeze|hang|regression|not\s+responding)\b",
    "thread": r"/t5/[^/]+/[^/]+/(?:td-p|m-p|idi-p)/\d+",
    "bug": r"/bug-reports?[-\w]*/[\w%-]+/\d+",
    "question": r"^/[a-z][a-z0-9]*-\d+/[a-z0-9%\-]+-\d+/?$",
}

#: Characters on either side of an edition in which license words do not count it.
ACROBAT_WINDOW = 45

# OBS Studio, what names a concrete issue, a report for developers only, and a user's problem all the same.
OBS_ISSUE_TERMS = (
    "crash", "freeze", "frozen", "freezing", "hang", "hangs", "hanging", "black screen", "green screen", "blue screen", "bsod", "no audio", "no sound",
    "no video", "no display", "no signal", "no output", "won't start", "wont start", "doesn't start", "does not start", "not starting", "won't launch",
    "wont launch", "fails to launch", "won't open", "can't open", "cannot open", "won't install", "can't install", "cannot install", "failed to install",
    "install fail", "installation fail", "won't update", "can't update", "failed to update", "update fail", "fails", "failed", "failing", "failure",
    "fails to", "not working", "doesn't work", "does not work", "no longer works", "stopped working", "quit working", "broken", "broke", "breaks",
    "breaking", "regression", "regressed", "error", "errors", "glitch", "artifact", "artifacts", "stutter", "stuttering", "dropped frame",
    "dropped frames", "drop frames", "frame drop", "skipped frames", "corrupt", "corrupted", "corruption", "data loss", "lag", "laggy", "slowdown",
    "slow to", "very slow", "extremely slow", "memory leak", "high cpu", "cpu usage", "100% cpu", "gpu usage", "overheat", "incompatible",
    "not compatible", "compatibility issue", "vulnerability", "exploit", "security issue", "security flaw",
)
OBS_DEVELOPER_TERMS = (
    "build failure", "build fails", "fails to build", "fails to configure", "configure when", "compile", "compiler", "cmake", "enable_plugins",
    "github actions", "developer", "libobs-metal fails", "there is no build log",
)
OBS_USER_TERMS = (
    "crashes on quit", "crash if", "freeze", "hang", "lag", "recording", "streaming", "audio mixer", "web camera", "screen capture", "black screen",
    "black square", "hotkey", "pipewire", "xcomposite", "rescale output", "mouse cursor",
)
OBS_TEMPLATE = r"###\s*(OBS Studio Log URL|OBS Studio Crash Log URL|Other OS|Operating System Info|OBS Studio Version(?: \(Other\))?)"

# Windows 11.
WINDOWS = {
    "symptom": (
        r"\b(?:bsod|blue[\s-]?screen|bug[\s-]?check|stop\s+(?:code|error)|0x[0-9a-f]{6,8}|won'?t\s+boot|fails?\s+to\s+boot|boot\s*loop|black\s+screen|"
        r"(?:install(?:ation)?|update|upgrade)\s+(?:fail(?:ed|s|ure|ing)?|error)|fails?\s+to\s+install|won'?t\s+install|error\s+0x|rolls?\s+back|rolled\s+back|"
        r"rollback|printer|printing|no\s+(?:audio|sound|network|internet|wi[\s-]?fi|display|signal)|driver\s+(?:crash|fail)|crash(?:es|ing|ed)?|freez(?:e|es|"
        r"ing|en)|hang(?:s|ing|ed)?|not\s+working\s+after|broke(?:n)?\s+after|stopped\s+working\s+after)\b"
    ),
    "how_to": (
        r"\b(?:how\s+(?:do|can|would|should)\s+i|how\s+to|where\s+(?:is|do|can)|is\s+it\s+safe\s+to|should\s+i\s+(?:install|update|upgrade)|which\s+version|"
        r"what'?s\s+the\s+best|recommend(?:ation)?)\b"
    ),
    "note": r"\b(?:release\s+notes|change\s*log|what'?s\s+new|known\s+issues\s+(?:for|in|list)|official\s+(?:documentation|guidance|list))\b",
    "announcement": (
        r"\b(?:now\s+available|is\s+available|announc(?:e|es|ing|ed|ement)|general\s+availability|rolling\s+out|is\s+released|has\s+been\s+released|"
        r"is\s+now\s+released)\b"
    ),
    "tenant": (
        r"\b(?:tenant|service\s+health|admin\s+center|message\s+center|exchange\s+online|sharepoint\s+online|onedrive\s+for\s+business|"
        r"microsoft\s+365\s+(?:service|admin)|service\s+(?:incident|degradation|outage|advisory))\b"
    ),
    "account": (
        r"\b(?:sign[\s-]?in|log[\s-]?in|password\s+reset|account\s+(?:locked|issue|problem)|activation\s+(?:error|fail)|licens(?:e|ing)\s+(?:error|issue)|"
        r"azure\s+ad|entra\s+id|\bmfa\b|multi[\s-]?factor|authenticat(?:e|ion)\s+(?:error|fail))\b"
    ),
    "latest": (
        r"\b(?:latest|newest|most\s+recent|recent|last)\s+(?:update|patch|cumulative\s+update|build)\b|\bthis\s+month'?s\s+(?:update|patch)\b|"
        r"\brecent\s+windows\s+update\b"
    ),
    "patch_tuesday": r"\bpatch\s+tuesday\b",
    "month_year": (
        r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|"
        r"dec(?:ember)?)\s+20\d{2}\b"
    ),
    "failure": (
        r"\b(?:will\s+not\s+install|won'?t\s+install|wont\s+install|fail(?:ed|s|ing)?\s+to\s+(?:install|update|apply|complete)|cannot\s+install|"
        r"can'?t\s+install|unable\s+to\s+install|install(?:ation)?\s+(?:fail(?:ed|s|ure|ing)?|error|stuck|loop)|update\s+(?:fail(?:ed|s|ure|ing)?|error|stuck|"
        r"loop)|update\s+(?:will\s+not|won'?t|wont)\s+(?:install|complete|finish)|update\s+not\s+(?:install\w*|function\w*|complet\w*|working)|"
        r"windows\s+update\s+not\s+(?:function\w*|working)|updates?\s+fail(?:ed|s|ing)?|stuck\s+(?:install\w*|updat\w*|download\w*)|restart(?:ing|"
        r"ed)?\s+to\s+install|keeps?\s+(?:fail\w*|restart\w*)\s+to\s+install|failed\s+attempts?\b|rollback\s+loop|error\s+(?:code\s+)?0x[0-9a-f]{4,8})"
    ),
    "since": (
        r"(?:after\b[^.]{0,45}\b(?:updat\w*|upgrad\w*|install\w*|applied|kb\s?\d{6,7}|build\s?\d{5})|since\b[^.]{0,45}\b(?:updat\w*|upgrad\w*|install\w*|"
        r"kb\s?\d{6,7})|(?:updat\w*|upgrad\w*|install\w*|kb\s?\d{6,7})\b[^.]{0,45}\b(?:no\s+longer|stopped\s+work\w*|broke|breaks|can'?t|cannot|unable|"
        r"fails?\b)|immediately\s+after\b[^.]{0,30}\b(?:updat\w*|install\w*|kb)|when\b[^.]{0,45}\b(?:kb\s?\d{6,7}|"
        r"update)\b[^.]{0,25}\binstall\w*[^.]{0,50}\b(?:no\s+longer|can'?t|cannot|unable|fail\w*|stop\w*|broke)|(?:no\s+longer|stopped)\s+(?:work\w*|respond\w*|"
        r"abl\w*|connect\w*)\b[^.]{0,50}\b(?:updat\w*|kb\s?\d{6,7})|(?:uninstall\w*|remov\w*|roll\w*\s*back|revert\w*)\b[^.]{0,45}\b(?:kb\s?\d{6,7}|update|"
        r"patch|it)\b[^.]{0,45}\b(?:fix\w*|resolv\w*|work\w*|solv\w*|help\w*)|(?:fix\w*|resolv\w*|work\w*\s+again|solv\w*)\b[^.]{0,45}\b(?:uninstall\w*|"
        r"remov\w*|roll\w*\s*back|revert\w*)\b[^.]{0,30}\b(?:kb\s?\d{6,7}|update|patch)|(?:uninstall\w*|remov\w*)\s+(?:the\s+)?(?:kb\s?\d{6,7}|update|patch)\b|"
        r"go\s+back\s+to\b[^.]{0,30}\b(?:previous\s+build|build\s?\d{5})|roll\w*\s*back\s+to\s+(?:the\s+)?previous\s+build)"
    ),
    "meta": (
        r"(?:rejected\s+(?:by\s+the\s+system\s+)?as\s+spam|flagged\s+as\s+spam|marked\s+as\s+spam|this\s+(?:post|subject|message|thread)\s+(?:was|is|"
        r"got)\s+(?:rejected|flagged)\b[^.]{0,20}\bspam|very\s+strange\b[^.]{0,40}\biso\b|\bmct\b[^.]{0,15}\biso|"
        r"media\s+creation\s+tool\b[^.]{0,30}\b(?:strange|weird|issues))"
    ),
    "feature": (
        r"\b(?:does\s+this\s+mean|what\s+does\s+this\s+mean|is\s+there\s+a\s+way\s+to|is\s+it\s+possible\s+to|can\s+(?:someone|anyone)\s+(?:explain|clarify)|"
        r"is\s+this\s+(?:normal|expected|by\s+design|intended)|what'?s\s+the\s+(?:difference|meaning|point|purpose))\b"
    ),
    "question": r"\b(?:how\s+do\s+i|how\s+to\b|how\s+can\s+i|why\s+can'?t\s+i|why\s+cant\s+i|where\s+(?:do|is|can)\s+i)\b",
    "driver": (
        r"(?:(?:intel|nvidia|amd|realtek|geforce|radeon|graphics?|display|chipset|network|wi-?fi|audio)\s+driver|driver\s+(?:version|update|upgrade|beyond)|"
        r"(?:upgrade|update|install|roll\s*back)\s+(?:the\s+|my\s+)?(?:intel|nvidia|amd|realtek|graphics?|display|audio|chipset)\s+driver)"
    ),
    "specs": (
        r"(?:secure\s+boot\s*[=:]|csm\s+(?:support\s+)?(?:enabled|disabled)|\btpm\s*(?:2\.0|version|enabled|:)|\bos\s+build\s*[:=]?\s*\d|\bedition\b\s*[:=]|"
        r"\bprocessor\b\s*[:=]|installed\s+ram\b|system\s+type\s*[:=]|device\s+specifications?|windows\s+specifications?|vs\.?\s*10\.0\.\d{5}|"
        r"\bbios\b\s+(?:version|supporting|setting)|dxdiag|systeminfo)"
    ),
}

# PowerPoint.
POWERPOINT = {
    "product": r"\b(?:microsoft\s+)?power\s?point\b",
    "other_app": (
        r"\b(?:excel|outlook|onenote|publisher|visio)\b|\b(?:microsoft\s+|ms\s+)(?:word|access|project|teams)\b|\b(?:word|access|project|teams)\s+(?:app|"
        r"application|document|doc|file|workbook|spreadsheet|database|mailbox|online|server)\b|(?:^|[\s(\[\-])(?:word|access|project|teams)\s*[:\-]|\b(?:word|"
        r"access|project|teams)\s+(?:version\s+)?(?:2\d(?:0[1-9]|1[0-2]))\b"
    ),
    "current": r"\bcurrent\s+channel\b",
    "preview": r"\bcurrent\s+channel\s*\(?\s*preview",
    "other_channel": (
        r"\b(?:monthly\s+enterprise(?:\s+channel)?|semi[\s-]?annual(?:\s+enterprise)?(?:\s+channel)?|beta\s+channel|insider(?:\s+(?:fast|slow|beta|preview))?|"
        r"dev\s+channel)\b"
    ),
    "store": r"\b(?:microsoft\s+store|windows\s+store|store\s+(?:app|version)|uwp)\b",
    "latest": (
        r"\b(?:latest|newest|most\s+recent|recent|last)\s+(?:update|patch|version|build|release)\b|\bthis\s+month'?s\s+(?:update|patch)\b|"
        r"\bafter\s+(?:the\s+)?(?:last|latest|recent)\s+update\b"
    ),
    "issue": (
        r"\b(?:crash(?:es|ing|ed)?|won'?t\s+(?:open|start|launch)|does\s+not\s+open|cannot\s+open|can'?t\s+open|fail(?:s|ed|ing)?\s+to\s+(?:open|start|launch|"
        r"save|export|load|respond)|freez(?:e|es|ing|en)|hang(?:s|ing|ed)?|not\s+responding|corrupt(?:s|ed|ion)?|damaged\s+(?:file|presentation|deck)|"
        r"blank\s+(?:slide|presentation|deck)|can'?t\s+save|cannot\s+save|save\s+(?:fail\w*|error)|unable\s+to\s+save|lost\s+(?:my\s+)?(?:work|slides|changes)|"
        r"data\s+loss|slide[\s-]?show\s+(?:fail\w*|crash\w*|black|freez\w*|won'?t\s+start|not\s+working)|presenter\s+view\s+(?:broken|not\s+working|black)|"
        r"export\s+(?:fail\w*|error|broken)|can'?t\s+export|animation[s]?\s+(?:broken|not\s+working|glitch\w*|regress\w*|stutter\w*)|transition[s]?\s+(?:broken|"
        r"not\s+working)|render(?:s|ing|ed)?\s+(?:issue|error|broken|wrong|incorrect)|add[\s-]?in[s]?\s+(?:broken|not\s+working|crash\w*|incompatib\w*|fail\w*|"
        r"disabled)|(?:very\s+)?slow|lag(?:s|ging|gy)?|performance\s+(?:regress\w*|issue|problem)|high\s+cpu|memory\s+leak|install(?:ation)?\s+(?:fail\w*|error|"
        r"stuck|loop)|update\s+(?:fail\w*|error|broke\w*|stuck)|broke\w*\s+after|stopped\s+working\s+after|no\s+longer\s+works?\s+after|not\s+working\s+after|"
        r"regress\w*|bug|glitch|error\s+message)\b"
    ),
    "how_to": (
        r"\b(?:how\s+(?:do|to|can|would|should)\b|where\s+(?:is|do|can)\b|is\s+it\s+safe\s+to\b|is\s+it\s+possible\s+to\b|can\s+(?:i|we|you)\s+\w+|i(?:'m|"
        r"\s+am)\s+trying\s+to\b|does\s+(?:microsoft\s+)?(?:power\s?point|ppt|it|this)\s+(?:support|have|allow|include|offer|let|do)\b|should\s+i\s+(?:install|"
        r"update|upgrade)\b|which\s+version\b|what'?s\s+the\s+best\b|feature\s+request|please\s+add|can\s+you\s+add|would\s+like\s+(?:to\s+see|a\s+feature|"
        r"the\s+ability)|is\s+there\s+a\s+way\s+to|how\s+about\s+adding)\b"
    ),
    "note": (
        r"\b(?:now\s+available|is\s+available|announc(?:e|es|ing|ed|ement)|general\s+availability|rolling\s+out|is\s+released|has\s+been\s+released|"
        r"release\s+notes|what'?s\s+new|change\s*log|new\s+features|version\s+history)\b"
    ),
    "announcement_title": (
        r"\b(?:microsoft\s+released\s+(?:update|version|build)|released\s+(?:update|version|build)|update\s+released|build\s+released|new\s+update\s+available|"
        r"now\s+available|is\s+available|current\s+channel\s+(?:update|release)|release\s+notes|what'?s\s+new|new\s+features|announc(?:e|es|ing|ed|ement)|"
        r"roll(?:ing|s|ed)?[\s-]?out|rollout|version\s+history|fixed\s+issues|known\s+issues|update\s+summary|general\s+availability|change\s*log)\b"
    ),
    "location": (
        r"\b(?:can'?t|cannot|unable\s+to)\s+find\b|\bwhere\s+(?:is|are|did|do|can|has)\b|\bwhere\s+.{0,40}?\bgo(?:ne|es)?\b|\bmissing\s+(?:button|menu|option|"
        r"feature|command|ribbon|toolbar|icon|tab|setting|function)\b|\b(?:button|menu|option|feature|command|ribbon|toolbar|icon|tab|setting|"
        r"function)\s+(?:is\s+)?missing\b|\bhow\s+(?:do|can|to|would|should)\s+i\b|\bwhich\s+setting\b|\b\w+\s+function\s+(?:is\s+)?(?:missing|gone|"
        r"disappear\w*)\b|\b(?:can'?t|cannot|unable\s+to)\s+(?:find|locate|see)\s+(?:the\s+|my\s+)?(?:\w+\s+){0,3}(?:function|feature|button|menu|option|"
        r"command|tool|setting)\b"
    ),
    "regression": (
        r"\b(?:worked|working|was\s+(?:there|available|fine|present)|used\s+to\s+(?:work|be))\b[^\n]{0,60}?\b(?:before|until|prior\s+to)\b|\b(?:disappear\w*|"
        r"gone|removed|missing|broke\w*|stopped\s+working|no\s+longer\s+(?:work\w*|available|there)|crash\w*|error|fail\w*)\b[^\n]{0,50}?\b(?:after|since|"
        r"following|once\s+i)\b[^\n]{0,50}?\b(?:updat\w*|version|patch|install\w*|upgrad\w*|2\d(?:0[1-9]|1[0-2]))\b|\bafter\s+(?:installing|updating|"
        r"the\s+update|the\s+patch|version|upgrad\w*)\b[^\n]{0,70}?\b(?:crash\w*|error|broke\w*|fail\w*|gone|missing|disappear\w*|no\s+longer|stopped|"
        r"grey(?:ed)?\s+out|can'?t)\b|\b(?:broke|stopped\s+working|no\s+longer\s+works?|not\s+working|disappeared|greyed?\s+out)\s+(?:right\s+|"
        r"immediately\s+)?after\b"
    ),
    "truncated": r"(?:…|\.\.\.|\[\s*\.\.\.\s*\]|&hellip;|\bread\s+more\b|\bsee\s+more\b|\bshow\s+more\b)\s*$",
    "historical": (
        r"\b(?:upgrad\w+\s+from|updat\w+\s+from|migrat\w+\s+from|switch\w+\s+from|mov\w+\s+from|came?\s+from|went\s+from|was\s+(?:on|using|running)|"
        r"previously\s+(?:on|using|had|ran)|prior\s+version|old(?:er)?\s+version|before\s+(?:updating|installing|the\s+update|"
        r"upgrad\w+))\s+(?:to\s+)?(?:version\s+)?(?:2\d(?:0[1-9]|1[0-2]))\b"
    ),
    "version": r"(?<![0-9.])(2\d(?:0[1-9]|1[0-2]))(?![0-9.])",
    "build": r"(?<![0-9.])(\d{4,6}\.\d{4,6})(?![0-9.])",
}

# Captured pages.
CAPTURE = {
    "announcement_url": r"/announcements-|helpx\.adobe\.com",
    "announcement": (
        r"\b(?:official\s+announcement|release\s+notes|what.?s\s+new|version\s+history|we.?ve\s+just\s+released|bringing\s+a\s+range\s+of\s+improvements|"
        r"new\s+features)\b"
    ),
    "missing": (
        r"\b(?:missing|unavailable|not\s+available|do(?:es)?\s+not\s+appear|won.?t\s+appear|impossible\s+to|cannot\s+(?:mask|open|export|render|use)|"
        r"can.?t\s+(?:mask|open|export|render|use))\b"
    ),
    "broke": r"\b(?:regression|after\s+updat|since\s+updat|freez|crash|broken|bug)\b",
}

# Links, titles and dates of changelog pages.
CHANGELOG = {
    "entry": ("/changelog/", "/release-notes/", "/releases/"),
    "no_entry": r"(?i)/(tag|tags|category|categories|author|page|feed|rss|atom)/",
    "untitled": "Official changelog update",
    "suffix": r"(?i)\s+[|–-]\s+Netlify\s*$",
    "date": r"([A-Z][a-z]{2,8}\s+\d{1,2},\s+\d{4}|\d{4}-\d{2}-\d{2})",
}
CHANGELOG_SITES = {"netlify_changelog": (("www.netlify.com", "netlify.com"), r"(?i)/changelog/\d{4}/\d{1,2}/\d{1,2}/[^/?#]+/?$")}

# The public sentences of a current Windows version.
WINDOWS_RELEASE = {
    "current": "{} is a current General Availability Channel servicing version. Latest OS build {}.",
    "revised": " Latest revision date {}.",
    "source": (
        " This is the official Microsoft Windows release-health entry (learn.microsoft.com/windows/release-health). Known-issue and safeguard-hold"
        " details are published on the per-version Windows release-health status page."
    ),
    "summary": "Windows 11 {} latest OS build is {}",
}
