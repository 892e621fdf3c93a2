"""Reference data sets kept in a local folder."""

from __future__ import annotations

import os
import shutil
import urllib.request
import zipfile

# Public addresses and file names.
DATASETS = {
    "clinvar_gene_summary": ("https://ftp.ncbi.nlm.nih.gov/pub/clinvar/tab_delimited/gene_specific_summary.txt", "gene_specific_summary.txt"),
    "reactome_pathways": ("https://reactome.org/download/current/ReactomePathways.gmt.zip", "ReactomePathways.gmt.zip"),
}


def fetch(name: str, folder: str, force: bool = False, timeout: float = 60) -> str:
    """The path of the data set: what is in the folder already, if it isn't empty, else a download; zip files unpacked."""
    url, file = DATASETS[name]
    path = os.path.join(folder, file)
    if force or not os.path.exists(path) or not os.path.getsize(path):
        os.makedirs(folder, exist_ok=True)
        with urllib.request.urlopen(url, timeout=timeout) as source, open(path + ".part", "wb") as to:
            shutil.copyfileobj(source, to)
        os.replace(path + ".part", path)
    return unpacked(path)


def unpacked(path: str) -> str:
    """Of a zip file the first .gmt in it, else its first file."""
    if not path.endswith(".zip"):
        return path
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.endswith(".gmt")] or z.namelist()
        return z.extract(names[0], os.path.dirname(path))
