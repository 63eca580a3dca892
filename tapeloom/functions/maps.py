"""Sector display names."""

from __future__ import annotations

# Feed sector name -> display name. Several names share one display.
SECTOR_DISPLAY = {
    "Technology": "テクノロジー",
    "Health Care": "ヘルスケア",
    "Financials": "金融",
    "Consumer Discretionary": "一般消費財",
    "Communication Services": "通信・メディア",
    "Industrials": "資本財",
    "Consumer Staples": "生活必需品",
    "Energy": "エネルギー",
    "Real Estate": "不動産",
    "Materials": "素材",
    "Utilities": "公益",
    "Healthcare": "ヘルスケア",
    "Financial Services": "金融",
    "Consumer Cyclical": "一般消費財",
    "Consumer Defensive": "生活必需品",
    "Basic Materials": "素材",
}
