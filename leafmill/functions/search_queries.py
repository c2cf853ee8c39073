"""Default search queries for a subject, from templates by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip

#: Templates of default queries; {name} is the subject, {code} its code.
COMPANY = (
    "{name} 年报 财务报表 主营业务 核心竞争力",
    "{name} 研究报告 投资价值 行业地位",
    "{name} 财务分析 ROE 毛利率 现金流",
    "{name} 竞争对手 行业对比 市场份额",
    "{name} 估值分析 投资建议 目标价格",
    "{name} 管理层 公司治理 发展战略",
    "{name} 业务结构 收入构成 盈利模式",
    "{name} 风险因素 投资风险 经营风险",
)
COMPANY_CODE = ("{code} {name} 股票分析 投资价值", "{code} 财务数据 业绩预测 估值水平")
INDUSTRY = (
    "中国{name} 行业研究报告 市场规模 发展趋势",
    "{name} 产业链分析 竞争格局 主要企业",
    "中国{name} 政策支持 发展规划 投资机会",
    "{name} 技术发展 创新应用 未来前景",
    "中国{name} 市场份额 增长率 统计数据",
    "{name} 行业分析 发展现状 挑战机遇",
    "中国{name} 重点企业 融资情况 商业模式",
    "{name} 产业发展报告 市场前景分析",
)
MACRO = (
    "{name} GDP CPI 利率 汇率 宏观指标 政策传导 site:stats.gov.cn OR site:pbc.gov.cn filetype:pdf",
    "{name} 经济增长 通胀 就业 投资 消费 (政策效应 OR 影响评估) site:gov.cn",
    "{name} 货币政策 财政政策 产业政策 (协调 OR 联动) 宏观调控",
    "{name} 政策实施 落地情况 执行效果 (试点 OR 示范) site:gov.cn filetype:pdf",
    "{name} 产业发展 技术创新 市场规模 (增长率 OR 渗透率) 统计数据",
    "{name} 企业应用 商业模式 产业链 (上中下游 OR 生态圈) 发展报告",
    "{name} 区域差异 省市对比 (东部 OR 中部 OR 西部) 发展不平衡 site:gov.cn",
    "{name} 城市群 经济圈 协同发展 (京津冀 OR 长三角 OR 粤港澳) 政策联动",
    "{name} 地方政策 配套措施 因地制宜 (北京 OR 上海 OR 深圳 OR 杭州)",
    "{name} 国际比较 全球竞争 (中美 OR 中欧) 技术竞争 政策对比",
    "{name} 全球供应链 国际合作 外溢效应 跨境投资 site:oecd.org OR site:worldbank.org",
    "{name} 贸易影响 出口竞争力 (制造业 OR 服务业) 国际市场份额",
    "{name} 风险预警 挑战问题 (数据安全 OR 就业替代 OR 技术风险) 监管政策",
    "{name} 系统性风险 灰犀牛 (泡沫 OR 过热 OR 结构性问题) 宏观审慎",
    "{name} 可持续发展 长期影响 (环境 OR 社会 OR 伦理) 治理机制",
)
#: What a theme may begin with, and the queries of a report's section.
THEME_PREFIX = "宏观："
SECTION = ("{name} {section}", "{name} {section} 分析", "{name} {section} 发展")


def filled(template: str, **values: Column) -> Column:
    """The template with its fields; null where one of those that it has is null."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        parts += [F.lit(before), values[field]]
    return F.concat(*parts, F.lit(rest))


def default_queries(subjects: DataFrame, kind: str = "kind", name: str = "name", code: str = "code") -> DataFrame:
    """``subjects`` with a row for each query, ``no`` (from 1) and ``query``; kinds are company, industry and macro.

    A company with a code that is not empty has two queries more; a theme goes without its prefix; other kinds have none.
    """
    has_code = F.coalesce(F.col(code), F.lit("")) != ""
    theme = strip(F.replace(F.col(name), F.lit(THEME_PREFIX), F.lit("")))
    of = lambda templates, subject: F.array(*(filled(t, name=subject, code=F.col(code)) for t in templates))
    none = F.array().cast("array<string>")
    queries = (
        F.when(F.col(kind) == "company", F.concat(of(COMPANY, F.col(name)), F.when(has_code, of(COMPANY_CODE, F.col(name))).otherwise(none)))
        .when(F.col(kind) == "industry", of(INDUSTRY, F.col(name)))
        .when(F.col(kind) == "macro", of(MACRO, theme))
        .otherwise(none)
    )
    return subjects.select("*", F.posexplode(queries).alias("no", "query")).withColumn("no", F.col("no") + 1)


def section_queries(sections: DataFrame, name: str = "name", section: str = "section", most: int = 3) -> DataFrame:
    """``sections`` with a row for each of the first ``most`` queries of a section."""
    queries = F.array(*(filled(t, name=F.col(name), section=F.col(section)) for t in SECTION[:most]))
    return sections.select("*", F.posexplode(queries).alias("no", "query")).withColumn("no", F.col("no") + 1)
