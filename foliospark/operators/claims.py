"""The audit of absolute claims: terms in their sentences, classified by context.

Lines with a term pass an Arrow task that blanks code spans and embeds in place,
as contexts are counted in characters.  The rest is Catalyst: a line is cut before
each term, running lengths give the term's place, and the sentence and the
contexts are substrings of the line.

Cases: null and empty texts have no claims; equal sentences of one line give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.markdown import visible_prose
from foliospark.functions.text import lines_of
from foliospark.operators.classify import first_match

# The terms of the audit and the contexts that change what they claim.
TERMS = "首次提出|必然|完全|解决|保证|显著提升"
SKIPPED_TYPES = ["agent_rule", "coverage_audit", "global_coverage_audit", "source_manifest", "source_manifest_history", "template", "vault_audit"]
SKIPPED_NAMES = "(?i)(^|/)99_|全仓例题索引|source_manifest"
COMPLETE_PERFORMANCE = "完全(?:解决|恢复|保证|提升|消除|避免|正确|可靠|无|没有)"
COMPLETE_TECHNICAL = (
    "完全(?:图|二叉树|匹配|平方|积分|连接|随机|背包|独立|可观测|竞争|限定|数据|序列|码|相同|一致|错位|均匀|没有|不用|基于|关闭|覆盖|重写|交互|一样|丢掉|错误|真实|可用|稳定|正确率)"
    r"|shape\s*完全正确"
)
NEGATED = (
    "不(?:一定|必然|能|会|等于|可|代表|保证|提供|再保证|成立|在|意味着|自动|构成|单独|表示|等同|具备|支持|受保证)"
    "|不是|并不是|没有|无须|未必|并非|尚未|无法|不能|不可|未提供|不提供|不足以|并无|不受保证|无保证|只保证|非(?:充分|必要)|而非|不承诺"
)
HEDGED = "通常|一般|可能|有助于|往往|部分|仅"
CONDITIONAL = (
    r"在[^。！？\n]{0,60}(?:条件|前提|假设|设置|场景|范围|约束|数据|参数|环境)[^。！？\n]{0,40}(?:下|中|时|内)"
    r"|(?:仅|只)?在[^。！？\n]{1,80}(?:下|内|中|时)[^。！？\n]{0,20}(?:保证|有保证|成立|有效)"
    r"|(?:若|如果|当|只要|除非|只有)[^。！？\n]{1,100}"
    r"|(?:满足|给定|基于|依赖(?:于)?|取决于)[^。！？\n]{0,60}(?:则|时|下|中|可以|能够|保证|成立|有效)"
    r"|(?:非负|有界|有限|无环|可终止|允许重开|满足[^。！？\n]{0,30}(?:约束|条件)|(?:[<>=≤≥]|不等于|等于)[^。！？\n]{0,80}(?:则|可保证|能够保证))[^。！？\n]{0,60}(?:保证|可|能够|成立|有效)"
    r"|(?:才能|必须[^。！？\n]{0,20}保证)[^。！？\n]{0,100}(?:正确|成立|一致|有效|完成|成功|回放|保证)"
    r"|(?:条件是|前提是|取决于|依赖于)"
    r"|(?:具体|精确)?要求依[^。！？\n]{1,60}(?:而定|而异)"
)
ASKED = r"[?？]|是否|能否|可否|为什么|为何|如何|怎样|吗(?:[，。！？]|$)|[“‘\"'].*[”’\"']"
FORMAL = (
    "定理|证明|推论|公理|定义|恒等|等式|正确性|不变量|充分条件|必要条件|协议|规范|线性化|串行化|形式化|可判定|等价性|安全性质|数学|公式|收敛|"
    "无损连接|故障恢复|停机|威胁假设|下界|最小解|抽屉原理|DFA|分母|分子|归一化|概率|求和|积分|最短路|PSD|内积|Softmax|softmax|mask|barrier|"
    "内存可见性|按序交付|事务补偿|交换性|calibration|KKT|Slater|量化|差分隐私|相邻数据集|输出分布|任意合法|合法实例|最小代价|相等|最优性|"
    "容量|元素数量|iterator|引用|生命周期|原子性|线程|内存|正确状态|可行域|无损|最坏情况|最小可行|token序列|合法 token|padding|embedding|失效|shape|dim|"
    "正值|正数|scale|Bernoulli|硬约束|算法结束|答案正确|自动机|状态集|初态|bitwise|exactly-once|checkpoint|读写顺序|写写顺序|WAW|WAR|"
    r"\\sum|w\(i,j\)|路径合法|合法性|候选边|邻接关系"
)
FORMAL_NOUN = "(?:质量|安全|一致性|可靠性|可用性|性能|责任|服务水平|风险|形式化|协议|保证程度|保证级别|最优性)保证"
CERTAIN_BY_DEFINITION = r"(?:数学|定义|公理|定理|证明|恒等|等式)[^。！？\n]{0,16}必然|必然[^。！？\n]{0,16}(?:定义|公理|定理|证明|恒等|等式)"
LABEL_CELL = r"(?:^|\|)\s*(?:保证|保证级别|面试中常用的保证|类型/?算法|容易说错的边界|字段|栏目|分类)\s*(?:\||$)"
LIST_LABEL = r"^\s*(?:[-*+]\s+|\d+[.)、]\s*)\*\*([^*]{1,120})\*\*\s*[:：]"
DEPENDS = "条件|前提|假设|设置|场景|范围|依赖|取决于"
LEGAL = "法律|法规|政策|监管|合规|法定"
UNIVERSAL = r"(?:保证|必然|完全)[^。！？\n]{0,16}(?:所有|全部|任何|一切)"
EVIDENCE = r"(?i)实验|结果|指标|数据|样本|对比|消融|报告|统计|百分点|%|PSNR|SSIM|AUC|p\s*[<=>]|论文|作者|参考|引用|doi|https?://|\[[^\]]+\]\("
PRESCRIBED = r"(?:先|应|需|必须|要|为|以|只|至少)\s*$"
TARGET_OF_WORK = r"要解决|需解决|需要解决|用于解决|可以帮助解决|能够帮助解决|旨在解决|针对解决|解决的是|解决什么|解决方法|解决方案|解决路径|解决框架|(?:强迫|试图|尝试|要求)[^。！？\n]{0,24}解决"
BROAD_SOLUTION = "完全|彻底|根本|有效|成功|无条件|一劳永逸|解决(?:所有|全部|任何|一切|梯度消失|梯度爆炸|过拟合|数据泄漏|分布漂移|通用问题|普遍问题|整体性能)"
CERTAIN_WITH_GROUNDS = r"已知|概率为 ?1|定理|证明|推论|不等式|有限|正数|任意合法|数学|条件|假设|不表示|公式|\$|="
COMPLETE_DENIED, COMPLETE_BOLD = "很难|难以|不(?:能|会)|不是|并非|没有", "完全(?:解决|保证|提升|消除|避免|正确|可靠)"
SOLVES_BOLD = "解决(?:梯度消失|梯度爆炸|所有|全部|任何|一切|通用|普遍|整体性能)"
ASSURED_WITH_GROUNDS = r"不(?:能|会)|依赖|前提|条件|只|不自动|特定|应|需|必须|需要|理论|定义|协议|算法|硬约束|公式|\$|=|并无"
ASSURED_BOLD = "保证(?:所有|全部|任何|完全|不存在|成功|最佳|覆盖关键)"
QUIET = ["LABEL_OR_SCHEMA", "QUESTION_OR_QUOTE", "NEGATED_GUARANTEE", "CONDITIONAL_GUARANTEE", "FORMAL_GUARANTEE"]
CATEGORIES = [*QUIET, "POLICY_OR_LEGAL_CLAIM", "EMPIRICAL_OVERCLAIM", "ENGINEERING_PROMISE", "MANUAL_REVIEW"]


def category(term: Column, sentence: Column) -> Column:
    """What kind of statement a sentence makes with the term; the first rule that fits decides."""
    label = F.regexp_extract(sentence, LIST_LABEL, 1)
    hedge = F.when(sentence.rlike(UNIVERSAL), "ENGINEERING_PROMISE").otherwise("MANUAL_REVIEW")
    tail = first_match([(term.isin("首次提出", "显著提升"), "EMPIRICAL_OVERCLAIM"), (term.isin("解决", "保证", "完全", "必然"), "ENGINEERING_PROMISE")], "MANUAL_REVIEW")
    plain = first_match(
        [
            (sentence.rlike(LABEL_CELL) | F.contains(label, term), "LABEL_OR_SCHEMA"),
            (sentence.rlike(ASKED), "QUESTION_OR_QUOTE"),
            (sentence.rlike(NEGATED), "NEGATED_GUARANTEE"),
            (sentence.rlike(CONDITIONAL), "CONDITIONAL_GUARANTEE"),
            (sentence.rlike(f"{FORMAL}|{FORMAL_NOUN}|{CERTAIN_BY_DEFINITION}"), "FORMAL_GUARANTEE"),
            (sentence.rlike(DEPENDS), "CONDITIONAL_GUARANTEE"),
            (sentence.rlike(LEGAL), "POLICY_OR_LEGAL_CLAIM"),
        ]
    )
    return F.coalesce(plain, F.when(sentence.rlike(HEDGED), hedge).otherwise(tail))


def high_confidence(term: Column, sentence: Column) -> Column:
    """Claims that block a strict gate: bold words without grounds, conditions or evidence."""
    bold = (
        F.when(term.isin("首次提出", "显著提升"), ~sentence.rlike(EVIDENCE))
        .when(term == "必然", ~sentence.rlike(CERTAIN_WITH_GROUNDS))
        .when(term == "完全", ~sentence.rlike(COMPLETE_DENIED) & sentence.rlike(COMPLETE_BOLD))
        .when(term == "解决", sentence.rlike(SOLVES_BOLD))
        .when(term == "保证", ~sentence.rlike(ASSURED_WITH_GROUNDS) & sentence.rlike(ASSURED_BOLD))
    )
    return ~sentence.rlike(f"[?？]|{NEGATED}|{CONDITIONAL}") & F.coalesce(bold, F.lit(False))


def occurrences(lines: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``term``, ``sentence``, ``prefix``, ``suffix``, ``around`` for each term of each ``line``."""
    rows = lines.where(F.col("line").rlike(TERMS)).select("path", "line_no", visible_prose("line").alias("prose")).where(F.col("prose").rlike(TERMS))
    parts = F.split("prose", f"(?={TERMS})")
    each = rows.select("*", F.posexplode(parts).alias("k", "part"), parts.alias("parts")).where(F.col("part").rlike(f"^(?:{TERMS})"))
    start = F.length(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ""))
    term = F.regexp_extract("part", f"^({TERMS})", 1)
    placed = each.select("path", "line_no", "prose", start.alias("at"), term.alias("term"))
    before, after = F.expr("substring(prose, 1, at)"), F.expr("substring(prose, at + length(term) + 1)")
    sentence = F.trim(F.concat(F.regexp_extract(before, "([^。！？]*)$", 1), "term", F.regexp_extract(after, "^([^。！？]*[。！？]?)", 1)))
    around = lambda left, right: F.expr(f"substring(prose, greatest(at - {left}, 0) + 1, at - greatest(at - {left}, 0) + length(term) + {right})")
    return placed.select("path", "line_no", "term", sentence.alias("sentence"), F.expr("substring(prose, greatest(at - 4, 0) + 1, least(at, 4))").alias("prefix"), F.substring(after, 1, 24).alias("suffix"), around(2, 12).alias("near"), around(20, 16).alias("around"))


def audit(lines: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``term``, ``sentence``, ``category``, ``high_confidence`` of the claims that need a look."""
    term, sentence = F.col("term"), F.col("sentence")
    found = occurrences(lines).withColumn("category", category(term, sentence))
    quiet = (
        F.col("category").isin(QUIET)
        | ((term == "完全") & (F.col("prefix").rlike("[不非没]$") | F.col("suffix").rlike("^[不无]") | ~F.col("near").rlike(COMPLETE_PERFORMANCE) | F.col("around").rlike(COMPLETE_TECHNICAL)))
        | ((term == "保证") & (F.col("prefix").rlike(PRESCRIBED) | sentence.rlike(FORMAL_NOUN) | F.col("suffix").startswith("金")))
        | ((term == "必然") & sentence.rlike(CERTAIN_BY_DEFINITION))
        | ((term == "解决") & (sentence.rlike(TARGET_OF_WORK) | ~sentence.rlike(BROAD_SOLUTION)))
        | (term.isin("首次提出", "显著提升") & sentence.rlike(EVIDENCE))
    )
    kept = found.where(~quiet).select("path", "line_no", "term", "sentence", "category", high_confidence(term, sentence).alias("high_confidence"))
    return kept.distinct()


def prose_lines(docs: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``line`` outside fences that are no headings; only documents with a term are split.

    Notes of an exempt name, and of an exempt type where ``note_type`` is given, are left out.
    """
    path = F.col("path").cast("string")
    spoken = docs.where(F.col("text").rlike(TERMS) & ~path.rlike(SKIPPED_NAMES))
    if "note_type" in docs.columns:
        spoken = spoken.where(~F.coalesce(F.col("note_type").isin(SKIPPED_TYPES), F.lit(False)))
    rows = spoken.select("path", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    so_far = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    marked = rows.withColumns({"fence": fence, "fences": F.sum(fence.cast("int")).over(so_far)})
    kept = marked.where("not fence and fences % 2 = 0").where(~F.col("line").rlike(r"^\s*#"))
    return kept.select("path", (F.col("i") + 1).alias("line_no"), "line")


def counts(claims: DataFrame) -> DataFrame:
    """Claims per category, and how many of them are of high confidence."""
    return claims.groupBy("category").agg(F.count("*").alias("n"), F.count_if("high_confidence").alias("high"))
