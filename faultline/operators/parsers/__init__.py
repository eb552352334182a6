"""Line parsers, one LineParser per log format."""

from faultline.operators.parsers.router import PARSERS, parse_all, parse_lines, parse_quality, register_parser

__all__ = ["PARSERS", "parse_all", "parse_lines", "parse_quality", "register_parser"]
