"""Word patterns and lists of the lesson, task and text rules.

All values here are fixed: results depend on them. ``\\b`` and ``\\w`` mean ASCII words in them.
"""

from __future__ import annotations

# Signs of concrete and of vague lessons.
CONCRETE = [
    r"\b(click|press|type|scroll|drag|select|open|close|navigate|search)\b",
    r"\b(button|menu|field|icon|window|tab|panel|dialog|checkbox)\b",
    r"\b(cmd|ctrl|alt|shift|enter|escape|space|delete)\b",
    r"\b(\d+|first|second|top|bottom|left|right|center)\b",
]
VAGUE = [
    r"\b(always|never|sometimes|maybe|probably|usually)\b",
    r"\b(careful|think|remember|consider|try|ensure)\b",
    r"\b(thing|stuff|item|element)\b(?! (button|field|menu))",
]

# Signs of lessons that say how, and of lessons that say what was.
ACTIONABLE = [
    r"^(use|try|click|press|type|avoid|wait|verify|check|ensure)",
    r"\b(should|must|need to|has to|recommended|better to)\b",
    r"\b(instead of|rather than|before|after|when|if)\b",
]
DESCRIPTIVE = [
    r"^(the agent|agent|it|this|that)",
    r"\b(was|were|had|happened|occurred|appeared)\b",
    r"\b(observed|noticed|saw|found)\b",
]

# Language of failure and of success.
FAILURE = r"\b(fail|error|incorrect|wrong|didn't work|unsuccessful)\b"
SUCCESS = r"\b(success|worked|effective|correct|successfully)\b"

# Signs of trivial and of novel lessons.
TRIVIAL = [
    r"\b(need to|should|must|have to|has to)\b.*\b(click|press|type|wait|check)\b",
    r"\b(agent|it|this|that)\b.*\b(did|tried|attempted|used)\b",
    r"^(use|try|click|wait)\s+\w+\s*$",
    r"\b(important|necessary|essential|critical|key)\b",
]
NOVEL = [
    r"\b(discovered|realized|learned|found that)\b",
    r"\b(surprisingly|unexpectedly|counterintuitively|note that)\b",
    r"\b(optimization|workaround|technique|strategy|pattern)\b",
    r"\b(avoid|prevent|bypass|instead)\b.*\b(because|due to|since)\b",
]

# Types of requests, the first that matches.
REQUEST_TYPES = [
    (r"\b(morning|briefing|daily|overview|summary)\b", "briefing"),
    (r"\b(remind|reminder|todo|task)\b", "reminders"),
    (r"\b(calendar|event|meeting|schedule)\b", "calendar"),
    (r"\b(mail|email|inbox)\b", "mail"),
    (r"\b(screen|screenshot|see|look|desktop|window)\b", "vision"),
    (r"\b(click|type|scroll|interact|open app)\b", "desktop_action"),
    (r"\b(battery|wifi|system|volume|disk)\b", "system_info"),
    (r"\b(remember|memory|store|recall)\b", "memory"),
    (r"\b(speak|say|voice|tts)\b", "speech"),
    (r"\b(search|web|google|find online)\b", "web_search"),
    (r"\b(note|notes|create note)\b", "notes"),
    (r"\b(contact|phone|call)\b", "contacts"),
    (r"\b(music|play|pause|song)\b", "music"),
    (r"\b(build|deploy|xcode|swift|compile)\b", "development"),
    (r"\b(schedule|cron|timer|interval)\b", "scheduling"),
]
OTHER_REQUEST = "general"

# Types of recorded demonstrations, the first that matches.
DEMO_TYPES = [
    (r"\b(open|launch|start)\b.*\b(app|application|program)\b", "app_launch"),
    (r"\b(search|find|look|google)\b", "web_search"),
    (r"\b(file|folder|directory|document)\b", "file_management"),
    (r"\b(settings|preferences|system|control)\b", "settings_change"),
    (r"\b(write|edit|type|text|document)\b", "text_editing"),
    (r"\b(email|mail|message|send)\b", "communication"),
    (r"\b(browser|chrome|safari|firefox|web)\b", "web_navigation"),
    (r"\b(screenshot|capture|record|snap)\b", "media_capture"),
    (r"\b(terminal|command|shell|cli)\b", "cli_interaction"),
]

# Types of goals reached on the way, the first that matches.
GOAL_TYPES = [
    (r"\b(open|launch|start)\b", "app_launch"),
    (r"\b(navigate|goto|visit|url)\b", "web_navigation"),
    (r"\b(click|press|select)\b.*\b(button|menu|icon)\b", "ui_interaction"),
    (r"\b(type|enter|input)\b", "text_input"),
    (r"\b(search|find)\b", "search"),
    (r"\b(close|quit|exit)\b", "app_management"),
]
OTHER_INTERACTION = "general_interaction"

# Actions that reach a goal on the way, where no checkpoint tells.
LAUNCHES = r"\b(open|launch|start)\b.*\b(app|application|safari|chrome|finder|terminal)\b"
NAVIGATIONS = r"\b(navigate|goto|visit|open|access)\b.*\b(url|website|page|folder|directory)\b"

# Words that make a task harder by .1, and patterns with what they add.
STEP_WORDS = [" then ", " after ", " and then ", " next ", " finally "]
HARDER = [
    (r"\b(if|when|unless|only if)\b", 0.2),
    (r"\b(else|otherwise|or)\b", 0.1),
    (r"\b(exact|specific|particular|precise)\b", 0.15),
    (r"\b(center|middle|top-right|bottom-left)\b", 0.1),
    (r"\b(menu|dropdown|context menu|right-click)\b", 0.1),
    (r"\b(nested|deep|hierarchy|subfolder)\b", 0.15),
    (r"\b(retry|wait for|ensure|verify|check)\b", 0.15),
    (r"\b(all|each|every|multiple)\b", 0.1),
]

# Stop words of the run index, of the session topics, and of expectations.
INDEX_STOPS = (
    "the a an and or but in on at to for of with by from as is was are were been "
    "be have has had do does did will would could should may might can this that these those it"
).split()
TOPIC_STOPS = (
    "the is at which on a an and or but in with to for of not no can will do does did has have had was were been be "
    "are am this that these those it its my your his her our their what how when where who why just also very really about from "
    "some any all each every both few more most other into over such than too only same so then now here there should could "
    "would may might must shall need want like please hey hi hello thanks thank yes no okay sure right well you me him them us"
).split()
EXPECTATION_STOPS = (
    "the a an is are was were be been being have has had do does did will would could should may might "
    "shall can to of in for on with at by from as into through during before after above below between under again further then "
    "once here there when where why how all each every both few more most other some such no nor not only own same so than "
    "too very just because but and or if while that this it i you he she we they me him her us them my your his its "
    "our their what which who see look like get got let now"
).split()

# The role an action is for, the roles that fit an action, and what an element must offer for it.
ROLE_OF_ACTION = {"click": "AXButton", "press": "AXButton", "type": "AXTextField", "enter": "AXTextField", "select": "AXMenuItem", "open": "AXMenuItem", "check": "AXCheckBox", "toggle": "AXCheckBox"}
FITTING_ROLES = {
    "click": ["AXButton", "AXMenuItem", "AXRadioButton", "AXCheckBox", "AXLink"],
    "type": ["AXTextField", "AXTextArea", "AXSearchField", "AXComboBox"],
    "select": ["AXMenuItem", "AXPopUpButton", "AXComboBox", "AXRadioButton"],
    "scroll": ["AXScrollArea", "AXTable", "AXList"],
    "check": ["AXCheckBox"],
    "toggle": ["AXCheckBox", "AXButton"],
}
OFFERED_ACTION = {"click": "AXPress", "press": "AXPress", "open": "AXShowMenu", "select": "AXPress", "type": "AXSetValue", "enter": "AXSetValue"}
ACTION_WORDS = "click|press|select|type|enter|open|check|toggle"
PLACE_WORDS = "toolbar|menu|sidebar|window|dialog|panel"

# Stop words of expected states.
STATE_STOPS = (
    "a an the is it in on at to of and or for with this that be was are has have "
    "do not no by as if from into which its their"
).split()

# Words that ask for the picture itself, and the colours and kinds that a label may name.
VISUAL_WORDS = "color|red|blue|green|icon|image|picture|screenshot|pixel|drawing|graphic"
COLOUR_WORDS = "red|blue|green|yellow|orange|purple|pink|black|white|gray"
PICTURE_WORDS = "icon|image|picture|graphic"

# Signs of requests for the larger model.
HARD_REQUESTS = [
    r"\b(refactor|architect|design|complex|analyze|debug)\b",
    r"\b(write|create|build|implement)\b.*\b(module|system|feature|app)\b",
    r"\b(code review|security audit|performance)\b",
    r"\bmulti.?step\b",
]

# What the code of a made tool must not have.
BLOCKED_CODE = [
    r"\brequire\s*\(",
    r"\bimport\s+",
    r"\beval\s*\(",
    r"\bFunction\s*\(",
    r"\bchild_process\b",
    r"\bexecSync\b",
    r"\bexecFile\b",
    r"\bspawnSync?\b",
    r"\bfs\b\.\b(write|unlink|rm|mkdir|rename|chmod|chown)",
    r"\bprocess\.exit\b",
    r"\bprocess\.env\b",
    r"\b__dirname\b",
    r"\b__filename\b",
    r"\bglobal\b\.",
    r"\bBuffer\.alloc\b",
]
LONGEST_CODE = 5000

# What in typed text may vary, in the order that settles ties.
VARIABLES = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("url", r"https?://[^\s]+"),
    ("date_iso", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("date_slash", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("money", r"\$\d+[\d,.]*\b"),
    ("home_path", r"~/[^\s]+"),
    ("absolute_path", r"/(?:Users|home|var|tmp|opt|etc)[^\s]+"),
]

# Shell commands that are refused.
BLOCKED_COMMANDS = [
    r"rm\s+-rf\s+/(?!\w)",
    r"mkfs\.",
    r"dd\s+if=.*of=/dev",
    r":()\{ :\|:& \};:",
    r">\s*/dev/sda",
]

# States of a tutorial, and those that each may be followed by.
TRANSITIONS = {
    "idle": ["listening", "cancelled"],
    "listening": ["planning", "idle", "cancelled"],
    "planning": ["guiding", "idle", "cancelled"],
    "guiding": ["validating", "correcting", "cancelled"],
    "validating": ["guiding", "correcting", "completed", "cancelled"],
    "correcting": ["guiding", "cancelled"],
    "completed": ["idle", "cancelled"],
    "cancelled": ["idle"],
}

# What a click in a text aims at, the first that fits.
CLICK_TARGETS = [
    r"(?:I'll|I will|Let me|I need to|I should|Going to|I'm going to)\s+click\s+(?:on\s+)?(?:the\s+)?(.+?)(?:\s+to\s+|\s+in\s+order|\s+so\s+|\s+at\s+|\s+which|\.|,|$)",
    r"""click(?:ing)?\s+(?:on\s+)?(?:the\s+)?["']([^"']+)["']""",
    r"click(?:ing)?\s+(?:on\s+)?(?:the\s+)?(.+?)(?:\s+button|\s+icon|\s+link|\s+tab|\s+menu|\s+field|\s+bar|\s+area|\s+at\s+|\.|,|\s*$)",
]

#: Applications that are known by name, in the order in which they are looked for.
KNOWN_APPS = [
    "safari", "notes", "textedit", "finder", "terminal", "calculator", "system settings", "system preferences", "calendar", "reminders", "mail", "messages", "maps", "music", "photos", "preview",
    "activity monitor", "disk utility", "keychain access", "console", "xcode", "automator", "font book", "digital color meter", "screen sharing", "bluetooth file exchange", "audio midi setup",
]

#: What shortcuts do.
SHORTCUTS = {
    "cmd+space": "Open Spotlight (universal app/file launcher)", "cmd+w": "Close current window/tab", "cmd+n": "New window/document", "cmd+z": "Undo last action", "cmd+c": "Copy selection",
    "cmd+v": "Paste from clipboard", "cmd+a": "Select all", "cmd+s": "Save", "cmd+q": "Quit application", "cmd+t": "New tab", "cmd+l": "Focus address/location bar", "cmd+f": "Find in page", "cmd+h": "Hide application",
}
