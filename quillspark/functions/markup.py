"""Fixed headings and notes of the Markdown texts in another language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replaced in this order, wherever they stand.
CHINESE = {
    "### Grounded summary": "### 证据式摘要",
    "### Supporting points": "### 支撑证据点",
    "**Main focus:**": "**研究重点：**",
    "**Approach / method:**": "**方法 / 路径：**",
    "**Key result:**": "**关键结果：**",
    "**Limitation / future work:**": "**局限 / 未来工作：**",
    "### Grounded answer": "### 基于原文证据的回答",
    "**Detected question type:**": "**识别的问题类型：**",
    "**Evidence strength:**": "**证据强度：**",
    "**Why:**": "**判断依据：**",
    "**Answer:**": "**回答：**",
    "**Evidence sources:**": "**证据来源：**",
    "Strong": "强",
    "Moderate": "中等",
    "Weak": "弱",
    "This is a grounded extractive summary.": "这是基于原文抽取的证据式摘要。",
    "The wording is lightly cleaned, but the factual content is selected from the original document.": "文字经过轻微清理，但事实内容来自原始文档。",
    "This QA mode is extractive and grounded.": "当前问答模式是基于原文抽取的证据式问答。",
    "It answers by selecting relevant sentences from the uploaded document, not by inventing new claims.": "它通过选择上传文档中的相关句子回答，而不是凭空生成新结论。",
    "The top answer sentence and its passage both had strong lexical support.": "排名最高的回答句及其所在段落都具有较强的文字匹配支持。",
    "Relevant complete source sentences passed the filters, but lexical support was not consistently strong.": "相关的完整原文句子通过了筛选，但文字匹配支持并不持续强。",
    "Only weak lexical support was found; verify the cited passage before using the answer.": "仅发现较弱的文字匹配支持；使用回答前请核对引用段落。",
}


def localized(c: Column, table: dict[str, str] = CHINESE) -> Column:
    """The text with each fixed phrase replaced in turn; a bare word such as a strength is replaced in evidence too."""
    for found, put in table.items():
        c = F.replace(c, F.lit(found), F.lit(put))
    return c
