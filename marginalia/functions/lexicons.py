"""Phrase lists and patterns of the lexical rules, by language."""

from __future__ import annotations

STALE = {
    "en": ["currently", "latest", "at present"],
    "zh": ["目前", "当前", "最新", "现在"],
    "ja": ["現在", "最新", "現時点"],
}
CONSTRAINT = {
    "en": ["or later", "or newer", "at least", "at most", "minimum", "maximum", "requires", "required"],
    "zh": ["以上", "以下", "至少", "最多", "要求", "不低于", "不高于"],
    "ja": ["以上", "以下", "以降", "少なくとも", "必要", "要件"],
}
COMMIT = {
    "en": ["commit", "sha", "build"],
    "zh": ["commit", "sha", "build", "提交", "构建"],
    "ja": ["commit", "sha", "build", "コミット", "ビルド"],
}
POINTER = {
    "en": ["see", "defined in", "refer to"],
    "zh": ["见", "参见", "参考", "定义在"],
    "ja": ["参照", "定義", "をご覧"],
}
SOURCE = {
    "en": ["see the source", "see source", "refer to the source", "see the code"],
    "zh": ["见源码", "见源代码", "参见源码", "参见源代码", "参考源码"],
    "ja": ["ソースを参照", "ソースコードを参照", "コードを参照"],
}
RATIONALE = {
    "en": ["why we chose", "why we choose", "why we use", "why not use"],
    "zh": ["为什么选择", "为何选择", "为什么不用", "为何不用", "为什么采用"],
    "ja": ["採用した理由", "選択した理由"],
}
CONVERSATION = {
    "en": [
        "as you requested", "as requested by you", "here's the updated", "here’s the updated", "here is the updated",
        "i hope this helps", "hope this helps", "as the user requested", "the user confirmed", "the user has confirmed",
        "the user approved", "the user has approved", "the user authorized", "the user has authorized",
    ],
    "zh": [
        "根据你的要求", "根据您的要求", "按你的要求", "按照你的要求", "希望对你有帮助", "希望对您有帮助", "根据用户的要求", "按照用户的要求", "经用户确认",
        "已与用户确认", "用户已确认", "经用户授权", "已获用户授权", "已获得用户授权", "用户已授权", "经用户同意", "已征得用户同意", "用户已同意",
    ],
    "ja": ["ご要望に応じて", "ご依頼のとおり", "ご依頼どおり", "お役に立てれば幸い"],
}
# What marks a phrase of CONVERSATION as a product's own end users.
END_USER_ADJACENT = ["未", "需", "须", "应", "不", "待", "等", "请", "若", "当"]
END_USER_CLAUSE = ["如果", "一旦", "只有", "除非", "确认", "确保", "检查", "验证", "核实", "必须", "需要", "要求", "是否", "判断"]
END_USER_WORDS = [
    "if", "once", "when", "whenever", "after", "until", "unless", "before", "whether", "verify", "ensure", "check", "confirm", "sure",
    "require", "requires", "required", "must", "should", "need", "needs", "only", "wait",
]
END_USER_AFTER = ["的", "后", "之后", "以后", "时"]
CLAUSE_BOUNDARIES = ",;:.!?，；：。！？、"
DEPLOYMENT = {
    "en": [
        "is deployed", "are deployed", "is currently deployed", "are currently deployed", "has been deployed",
        "have been deployed", "is live", "is running in production", "is not yet deployed", "has not been deployed", "not yet shipped",
    ],
    "zh": ["已部署", "已经部署", "已上线", "已经上线", "尚未部署", "尚未上线", "正在生产环境运行"],
    "ja": ["デプロイ済み", "デプロイされています", "本番稼働中", "まだデプロイされていません", "リリース済み"],
}
EXCLUDED_HEADING = {
    "en": ["what this does not", "what we did not", "what is not included", "out of scope", "non-goals", "without the"],
    "zh": ["不包含的", "不包括的", "不在范围", "本次不做", "非目标", "未包含"],
    "ja": ["対象外", "含まれない", "今回実施しない", "非目標"],
}
PRODUCTION_HEADING = {
    "en": [
        "implementation notes", "implementation approach", "what i changed", "what we changed", "changes made",
        "how i built", "how we built", "my approach",
    ],
    "zh": ["实现过程", "实现思路", "本次修改", "我做的修改", "修改说明", "制作过程"],
    "ja": ["実装メモ", "実装方針", "今回の変更", "作成過程", "変更した内容"],
}
NARRATION = {
    "en": ["i have implemented", "i implemented", "i have added", "i updated", "i created this", "this page demonstrates"],
    "zh": ["我已经实现", "我已实现", "我添加了", "我修改了", "本页面展示了实现过程"],
    "ja": ["私は実装しました", "私が追加した", "このページを作成しました"],
}
EVALUATION = {
    "en": [
        "is faster", "is the fastest", "is better", "is the best", "is superior", "is more efficient", "is recommended",
        "we recommend", "recommended approach", "best performance",
    ],
    "zh": ["更快", "性能更好", "最高效", "最佳方案", "最好的", "推荐使用", "我们推荐"],
    "ja": ["より高速", "最も高速", "最適な方法", "最高の性能", "推奨します", "を推奨"],
}
CONDITIONAL = [
    "if", "when", "unless", "once", "until", "after", "before", "whether", "verify", "check", "ensure", "confirm", "must",
    "should", "will", "would", "can be", "may be", "如果", "若", "当", "部署后", "部署前", "检查", "确认", "确保", "应当", "必须",
    "将", "可能", "是否", "場合", "とき", "なら", "確認", "必要", "してください", "予定", "かどうか",
]
# Words that show a state of deployment (English only).
DEPLOYMENT_STATE = [
    "currently", "now", "already", "has been deployed", "have been deployed", "has not been deployed", "not yet", "is live", "in production", "to production",
]
# Words that give a version a lasting or historical context, and phrases that state one.
VERSION_CONTEXT = [
    "versioned", "compatibility", "compatible", "introduced in", "added in", "deprecated in", "removed in", "fixed in", "license", "许可证",
    "ライセンス", "中得到解决", "since", "starting with", "example", "such as", "or higher", "or greater", "or earlier", "or lower", "prior to",
    "older than", "newer than", "up to", "for example", "e.g.", "支持", "兼容", "引入", "弃用", "例如", "対応", "以降", "導入", "例", "以前", "より前",
]
VERSION_STATE = [
    "version is", "version:", "release is", "release:", "runs version", "running version", "we use version", "版本为", "版本是", "版本：",
    "バージョンは", "バージョン:",
]
VERSION_WORDS = ["version", "release", "版本", "バージョン"]
# What supports an evaluation, and what a mere recommendation is.
RECOMMENDATION = ["recommend", "recommended", "推荐", "推奨"]
COMPARISON_WORDS = ["faster", "fastest", "better", "best", "superior", "efficient", "更快", "性能", "最高效", "高速"]
PREFERENCE_WORDS = [" over ", "rather than", "优于"]
REASONS = [
    "because", "since", "so that", "to avoid", "to ensure", "consistency", "this avoids", "this prevents", "因为", "为了", "避免", "一致性",
    "区分", "一貫性", "区別", "ため", "防ぐ",
]
EVIDENCE = ["measured", "benchmark", "benchmarks", "measurement", "测试结果", "基准测试", "实测", "ベンチマーク", "測定結果"]
# Headings and contexts of examples and of output.
EXAMPLE_HEADING = [
    "example output", "sample output", "example usage", "sample conversation", "example conversation", "示例输出", "输出示例", "示例对话", "使用示例",
    "出力例", "会話例", "使用例",
]
OUTPUT_HEADING = ["output", "assistant response", "sample conversation", "example conversation", "示例输出", "输出示例", "示例对话", "出力例", "会話例"]
OUTPUT_START = ["output", "expected output", "compiler output", "输出", "出力", "実行結果"]
OUTPUT_CONTEXT = [
    "following output", "following error", "output looks", "output should", "expected output", "will output", "will print", "get an error",
    "results in an error", "如下输出", "以下输出", "输出如下", "得到一个错误", "以下のエラー", "出力は", "エラーが発生", "エラーに",
]
# How instructions begin, and shells whose code is always run.
INSTRUCTION_LEAD = ["First, ", "Next, ", "Then, ", "Finally, ", "You can ", "You should ", "You must "]
INSTRUCTION = [
    "to start,", "to begin,", "let's implement", "let us implement", "run", "install", "open", "create", "set", "add", "select", "click", "use",
    "start", "connect", "copy", "edit", "configure", "build", "test", "download", "enter", "execute", "save", "remove", "check", "verify",
    "restart", "ask the user", "安装", "运行", "打开", "创建", "设置", "添加", "选择", "点击", "执行", "复制", "编辑", "配置", "下载", "输入", "保存",
    "检查", "确认", "首先", "然后", "接下来", "最后", "请", "让我们通过实现", "まず", "次に", "最後に",
]
INSTRUCTION_ANYWHERE = ["してください", "しましょう"]
SHELLS = ["sh", "bash", "shell", "powershell", "pwsh", "cmd", "bat", "zsh", "fish"]
# Decisions in prose, by language.
DECISION = {
    "en": ["we chose", "we choose", "we decided", "we opted", "our decision", "the trade-off is", "the tradeoff is"],
    "zh": ["我们选择", "我们决定", "之所以选择", "选择的原因", "选择了这个方案"],
    "ja": ["を選んだ理由", "を採用した理由", "を採用しました"],
}
# Headings that name a section's role.
ROLE_HEADINGS = {
    "troubleshooting": [
        "troubleshooting", "frequently asked questions", "faq", "exceptions", "known issues", "故障排查", "故障处理", "常见问题", "例外",
        "トラブルシューティング", "よくある質問",
    ],
    "reference": [
        "api reference", "configuration reference", "parameters", "return values", "options", "参数", "配置参考", "返回值", "パラメータ", "戻り値",
        "リファレンス", "オプション",
    ],
    "background": ["background", "overview", "concepts", "description", "背景", "概述", "概要", "概念", "总览", "説明", "例外処理"],
    "steps": [
        "quick start", "quickstart", "getting started", "installation", "install", "procedure", "安装步骤", "快速开始", "操作步骤", "インストール",
        "クイックスタート", "手順",
    ],
    "rationale": ["rationale", "design decisions", "设计决策", "设计理由", "设计权衡", "設計判断", "設計の理由", "trade-offs", "tradeoffs"],
}
DECISION_HEADINGS = ["rationale", "design decisions", "设计决策", "设计理由", "设计权衡", "設計判断", "設計の理由"]
DECISION_START = ["why we chose", "why we choose", "why we use", "为什么选择", "採用した理由"]
RATIONALE_START = ["why use", "为什么要用"]
TROUBLE_ANYWHERE = ["よくある質問", "not working", "not formatting", "does not work"]
EXERCISE_HEADINGS = ["knowledge check", "quiz", "exercise", "exercises", "知识检查", "练习", "知識チェック", "演習"]
REFERENCE_START = ["returns", "return type", "返回值", "返回类型", "函数会", "戻り値:", "引数の型:"]
REFERENCE_ANYWHERE = ["optional field", "must be annotated"]
NAVIGATION_START = ["read the", "see the", "looking for"]
# Patterns. Digits are any decimal digits where the rule's meaning is a bound or a comparison.
BOUND = r"(?:>=|<=|≥|≤|\p{Nd}(?:\.\p{Nd})*\+)"
VALUE = r"(?i)(?:v?[0-9]+(?:\.[0-9]+)+(?:[-+][a-z0-9.-]+)?|[a-f0-9]{7,40}|[a-z][a-z0-9_.-]*(?:/[a-z0-9_.-]+)*:[a-z0-9_.-]+|[0-9]+)"
HASH = r"[\s:=#]+([a-fA-F0-9]{7,40})(?:$|[^a-zA-Z0-9_])"
VERSION = r"(?i)\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][a-z0-9]+(?:[.-][a-z0-9]+)*)?\b"
VERSION_LABEL = r"(?i)^\s*(?:version|release)\s*[:=]?\s*v?[0-9]+\."
MEASUREMENT = r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:%|ms\b|seconds?\b|requests?/s\b|ops/s\b|mb/s\b|gb/s\b|倍|秒)"
COMPARISON = r"(?:[<>≤≥~=^]|\p{Nd}+(?:\.\p{Nd}+)+\s*(?:\+|[-–]))"
JAPANESE_CHOICE = r"^\s*なぜ.{1,100}(?:を選んだ|を選ぶ|を採用した|を採用する|を使わない|を使うのか)"
# File names and symbols that a source pointer may name.
SOURCE_EXTENSIONS = (
    "rs py pyi js jsx ts tsx c h cc cpp hpp cs go java kt swift rb php sh ps1 json toml yaml yml md markdown txt xml html css sql proto vue svelte"
).split()
SOURCE_FILES = ["Dockerfile", "Makefile", "LICENSE", "Cargo.lock"]
# Hosts of repositories and the first path parts that are no owner there.
FORGES = {
    "github.com": (
        "about apps collections customer-stories enterprise explore features login marketplace new notifications orgs pricing readme search security "
        "settings signup site sponsors topics users"
    ).split(),
    "gitlab.com": "- admin dashboard explore help users".split(),
    "codeberg.org": "admin explore issues notifications org pulls repo user".split(),
    "bitbucket.org": "account dashboard plans product site support".split(),
}
#: Ranks of document kinds when several own the same content; higher wins. Canonical documents rank 7, all others 1.
KIND_RANK = {"generated": 6, "reference": 5, "adr": 4, "howto": 3, "readme": 2}
